"""One pass over a blob: everything that rules, summaries and reports read from it."""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Callable

from lumenlake.kernels import icc, iptc, xmp
from lumenlake.kernels.jpeg import EXIF_ID, SCAN, SOF, XMP_ID, Segment, dimensions, fingerprint, full_walk, header_and_end, header_walk
from lumenlake.kernels.limits import DEFAULT, Limits, ParseError
from lumenlake.kernels.names import tag_name
from lumenlake.kernels.tiff import EXIF_POINTER, GPS_POINTER, TYPES, Block, Directory, has_value

#: Coding process of the first frame header.
PROCESSES = {
    0xC0: "Baseline DCT", 0xC1: "Extended sequential DCT", 0xC2: "Progressive DCT", 0xC3: "Lossless sequential", 0xC5: "Differential sequential DCT",
    0xC6: "Differential progressive DCT", 0xC7: "Differential lossless", 0xC9: "Arithmetic sequential DCT", 0xCA: "Arithmetic progressive DCT",
    0xCB: "Arithmetic lossless", 0xCD: "Differential arithmetic sequential", 0xCE: "Differential arithmetic progressive", 0xCF: "Differential arithmetic lossless",
}


def _exif_groups(data: bytes, limits: Limits, of: Callable[[Block, Directory, str], object]) -> dict[str, object]:
    """What ``of`` makes of IFD0, ExifIFD and GPS of one block."""
    block = Block.open(data, limits)
    ifd0 = block.directory(block.first)
    out = {"IFD0": of(block, ifd0, "IFD0")}
    for ifd, pointer in (("ExifIFD", EXIF_POINTER), ("GPS", GPS_POINTER)):
        d = block.child(ifd0, pointer)
        if d is not None:
            out[ifd] = of(block, d, ifd)
    return out


def _finding(code: str, message: str, *evidence: str) -> dict:
    medium = code == "duplicate_tag"
    return {"code": code, "severity": "medium" if medium else "high", "category": "structural", "message": message, "evidence": list(evidence)}


def structure(data: bytes, limits: Limits = DEFAULT) -> list[dict]:
    """Structural findings in one EXIF block; the block's own header or IFD0 failing is the caller's."""
    block = Block.open(data, limits)
    ifd0 = block.directory(block.first)
    groups: list[tuple[str, Directory]] = [("IFD0", ifd0)]
    out: list[dict] = []
    for ifd, pointer in (("ExifIFD", EXIF_POINTER), ("GPS", GPS_POINTER)):
        e = ifd0.find(pointer)
        if e is None:
            continue
        try:
            at = block.value(e)
        except ParseError as x:
            out.append(_finding("invalid_ifd_pointer", f"{ifd} pointer could not be decoded", str(x)))
            continue
        if not isinstance(at, int):
            out.append(_finding("invalid_ifd_pointer", f"{ifd} pointer is not an integer offset"))
        elif at < 8 or at >= len(data):
            out.append(_finding("suspicious_offset", f"{ifd} pointer is outside a safe TIFF range", f"offset={at}", f"TIFF size={len(data)}"))
        elif ifd0.offset <= at < ifd0.end:
            out.append(_finding("suspicious_offset", f"{ifd} pointer points inside its parent IFD directory", f"offset={at}"))
        else:
            try:
                groups.append((ifd, block.directory(at, 1)))
            except ParseError as x:
                out.append(_finding("invalid_ifd_pointer", f"{ifd} structure could not be parsed", f"offset={at}", str(x)))
    for ifd, d in groups:
        out += _entries(block, ifd, d)
    return out


def _entries(block: Block, ifd: str, d: Directory) -> list[dict]:
    out, counts = [], Counter([e.tag for e in d.entries])
    name = lambda tag: f"Tag={tag_name(ifd, tag)}"
    where = lambda e: (f"Group={ifd}", name(e.tag))
    for tag, n in counts.items():
        if n > 1:
            out.append(_finding("duplicate_tag", "Duplicate metadata tag detected", f"Group={ifd}", name(tag), f"Count={n}"))
    for e in d.entries:
        if e.type not in TYPES:
            out.append(_finding("invalid_tiff_type", "TIFF entry uses an unsupported or invalid field type", *where(e), f"Type={e.type}"))
            continue
        size = block.size(e)
        if size > 4:
            at = block.pointer(e)
            problem = (
                "points inside the TIFF header" if at < 8
                else "extends beyond the EXIF data" if at + size > len(block.data)
                else "points inside its own IFD directory" if at < d.end and at + size > d.offset
                else None
            )
            if problem:
                out.append(_finding("suspicious_offset", f"External TIFF value {problem}", *where(e), f"offset={at}", f"size={size}"))
                continue
        try:
            block.filled(e)
        except ParseError as x:
            out.append(_finding("tag_value_decode_error", "Metadata tag value could not be decoded", *where(e), str(x)))
    return out


def block_presence(payload: bytes, limits: Limits) -> tuple[str, str | None, str | None]:
    """Of one EXIF segment whether it points to GPS tags (YES, NO or UNKNOWN), its camera model, and what is wrong with it."""
    try:
        block = Block.open(payload[len(EXIF_ID) :], limits)
        ifd0 = block.directory(block.first)
        gps = "NO" if ifd0.find(GPS_POINTER) is None else "YES"
        model = ifd0.find(0x0110)
        text = block.value(model) if model is not None else None
        return gps, (text.strip() or None) if isinstance(text, str) else None, None
    except ParseError as e:
        return "UNKNOWN", None, str(e)


def segment_rows(data: bytes, limits: Limits, payload_of: frozenset[int], markers: frozenset[int] | None = None) -> dict:
    """Segments in order, all or of ``markers``, whole ones of those in ``payload_of``; those up to the first scan where the rest cannot be walked."""
    error = None
    try:
        walk = full_walk(data, limits=limits, keep_scans=SCAN in payload_of)
        found = [*walk.segments, *walk.scans]
    except (ParseError, struct.error) as e:
        error = str(e)
        try:
            found = header_walk(data, limits)
        except (ParseError, struct.error):
            return {"found": [], "error": error}
    rows = []
    for s in found if markers is None else [s for s in found if s.marker in markers]:
        gps, model, problem = block_presence(s.payload, limits) if s.is_exif else (None, None, None)
        rows.append(s.row() | {"late": s.late, "head": s.payload[:16], "payload": s.payload if s.marker in payload_of else None, "gps": gps, "camera_model": model, "problem": problem})
    return {"found": rows, "error": error}


def _presence(segments: list[Segment], limits: Limits) -> dict:
    """Presence of each kind of metadata in the whole file: YES, NO or UNKNOWN."""
    out = {"exif": "NO", "gps": "NO", "xmp": "NO", "iptc": "NO", "icc": "NO", "camera_model": None, "warnings": []}
    for s in segments:
        if s.is_exif:
            out["exif"] = "YES"
            out["gps"], model, problem = block_presence(s.payload, limits)
            out["camera_model"] = model or out["camera_model"]
            out["warnings"] += [f"EXIF: {problem}"] if problem else []
        elif s.is_xmp or s.is_extended_xmp:
            out["xmp"] = "YES"
        elif s.is_icc:
            out["icc"] = "YES"
        elif s.is_photoshop and out["iptc"] != "YES":
            try:
                out["iptc"] = "YES" if iptc.rows(s.payload, limits) is not None else out["iptc"]
            except ParseError as e:
                out["iptc"] = "UNKNOWN"
                out["warnings"].append(f"IPTC: {e}")
    return out


#: Columns that take each part of the work.
EXIF_COLUMNS = frozenset({"tags", "has"})
WALK_COLUMNS = frozenset({"jpeg_process", "scan_sha256", "scan_bytes", "trailing_bytes", "quantization", "huffman", "presence", "exif_segments", "structural"})


def parse(data: bytes, limits: Limits = DEFAULT, wanted: frozenset[str] | None = None, only: frozenset[str] | None = None, values: bool = True) -> dict:
    """All facts of a JPEG, or those ``wanted``; what fails is null and says why in ``errors``.

    ``only``: the tags, with their groups, that get rows (all are looked at, and one that is not sound fails all); ``values``: whether rows get values.
    """
    out: dict = {
        "width": None, "height": None, "segments": [], "tags": [], "xmp": [], "iptc": [], "icc": None,
        "presence": None, "jpeg_process": None, "scan_sha256": None, "scan_bytes": None, "trailing_bytes": None, "quantization": None, "huffman": None,
        "has": [], "has_xmp": [], "exif_segments": 0, "structural": [], "has_extended_xmp": False, "errors": [],
    }
    asked = lambda *names: wanted is None or not wanted.isdisjoint(names)
    fail = lambda part, e: out["errors"].append({"part": part, "message": str(e)})
    try:
        walked = header_and_end(data, limits)
        head = walked[0]
    except (ParseError, struct.error) as e:
        fail("header", e)
        head, walked = [], None
    if asked("segments"):
        out["segments"] = [s.row() for s in head]
    out["has_extended_xmp"] = any(s.is_extended_xmp for s in head)
    if head:
        try:
            out["width"], out["height"] = dimensions(head)
        except ParseError as e:
            fail("dimensions", e)
    if asked(*EXIF_COLUMNS):
        _exif_facts(out, head, limits, fail, asked, only, values)
    if asked("xmp", "has_xmp"):
        for k, packet in enumerate(s.payload[len(XMP_ID) :] for s in head if s.is_xmp):
            try:
                found = xmp.properties(packet, limits)
            except ParseError as e:
                fail("xmp", e)
                continue
            out["xmp"] += [{"packet": k} | p for p in found]
            out["has_xmp"] = list(dict.fromkeys(out["has_xmp"] + xmp.filled(found)))
    if asked("iptc", "has"):
        for s in head:
            if s.is_photoshop:
                try:
                    rows = iptc.rows(s.payload, limits)
                except (ParseError, struct.error) as e:
                    fail("iptc", e)
                    break
                if rows is not None:
                    out["iptc"] = rows
                    out["has"] += dict.fromkeys(f"IPTC/{r['name']}" for r in rows if has_value(r["text"]))
                    break
    if asked("icc"):
        try:
            profile = icc.reassemble([s.payload for s in head if s.is_icc], limits)
            out["icc"] = icc.parse(profile, limits) if profile is not None else None
        except (ParseError, struct.error) as e:
            fail("icc", e)
    if asked(*WALK_COLUMNS):
        _walk_facts(out, data, limits, fail, asked, walked)
    return out


def _exif_facts(out: dict, head: list[Segment], limits: Limits, fail, asked, only: frozenset[str] | None, values: bool) -> None:
    """Tags of the first EXIF segment."""
    first = next((s for s in head if s.is_exif), None)
    if first is not None:
        try:
            data = first.payload[len(EXIF_ID) :]
            if asked("tags"):
                groups = _exif_groups(data, limits, lambda b, d, ifd: b.tagged_rows(d, ifd, only, values))
                out["tags"] = [r for rows in groups.values() for r in rows]
            if asked("has"):
                out["has"] = [n for filled in _exif_groups(data, limits, Block.names_filled).values() for n, v in filled.items() if v]
        except (ParseError, struct.error) as e:
            fail("exif", e)


def _walk_facts(out: dict, data: bytes, limits: Limits, fail, asked, head: tuple[list[Segment], int] | None) -> None:
    """What takes a walk to the end of the file."""
    try:
        walk = full_walk(data, limits=limits, head=head)
    except (ParseError, struct.error) as e:
        fail("structure", e)
        return
    out["scan_sha256"], out["scan_bytes"], out["trailing_bytes"] = walk.scan_sha256, walk.scan_bytes, len(walk.trailing)
    out["quantization"], out["huffman"] = fingerprint(walk.segments, 0xDB), fingerprint(walk.segments, 0xC4)
    frame = next((s for s in walk.segments if s.marker in SOF), None)
    out["jpeg_process"] = "UNKNOWN" if frame is None else PROCESSES.get(frame.marker, f"SOF 0x{frame.marker:02X}")
    if asked("presence"):
        out["presence"] = _presence(walk.segments, limits)
    blocks = [s.payload[len(EXIF_ID) :] for s in walk.segments if s.is_exif]
    out["exif_segments"] = len(blocks)
    for b in blocks if asked("structural") else ():
        try:
            out["structural"] += structure(b, limits)
        except (ParseError, struct.error) as e:
            out["structural"].append(_finding("exif_structure_corrupt", "EXIF is declared but its TIFF structure could not be parsed", str(e)))
