"""JPEG marker streams: the header up to the first scan, and the whole file."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable
from dataclasses import dataclass, field

from lumenlake.kernels.limits import DEFAULT, Limits, ParseError, need

SOI, EOI, SOS, DNL, COM, TEM = 0xD8, 0xD9, 0xDA, 0xDC, 0xFE, 0x01
#: Stands for entropy-coded bytes where they are rows.
SCAN = -1
SOF = frozenset({*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC})
EXIF_ID = b"Exif\0\0"
XMP_ID = b"http://ns.adobe.com/xap/1.0/\0"
XMP_EXT_ID = b"http://ns.adobe.com/xmp/extension/\0"
ICC_ID = b"ICC_PROFILE\0"
PHOTOSHOP_ID = b"Photoshop 3.0\0"

#: Marker names. 0xC3 has none, though it is a frame header.
MARKER_NAMES = (
    {0x01: "TEM", 0xC4: "DHT", 0xC8: "JPG", 0xCC: "DAC", 0xD8: "SOI", 0xD9: "EOI", 0xDA: "SOS", 0xDB: "DQT", 0xDC: "DNL", 0xDD: "DRI", 0xDE: "DHP", 0xDF: "EXP", 0xFE: "COM"}
    | {m: f"SOF{m - 0xC0}" for m in SOF if m != 0xC3}
    | {0xD0 + i: f"RST{i}" for i in range(8)}
    | {0xE0 + i: f"APP{i}" for i in range(16)}
)


def marker_name(marker: int) -> str:
    return "SCAN" if marker == SCAN else MARKER_NAMES.get(marker) or f"UNKNOWN_{marker:02X}"


@dataclass(slots=True)
class Segment:
    seq: int
    offset: int
    marker: int
    declared_length: int | None
    payload: bytes
    late: bool = False  # after the first scan began
    size: int | None = None  # of the payload, where only its first bytes are here

    @property
    def is_exif(self) -> bool:
        return self.marker == 0xE1 and self.payload.startswith(EXIF_ID)

    @property
    def is_xmp(self) -> bool:
        return self.marker == 0xE1 and self.payload.startswith(XMP_ID)

    @property
    def is_extended_xmp(self) -> bool:
        return self.marker == 0xE1 and self.payload.startswith(XMP_EXT_ID)

    @property
    def is_icc(self) -> bool:
        return self.marker == 0xE2 and self.payload.startswith(ICC_ID)

    @property
    def is_photoshop(self) -> bool:
        return self.marker == 0xED and self.payload.startswith(PHOTOSHOP_ID)

    def row(self) -> dict:
        return {
            "seq": self.seq, "offset": self.offset, "marker": self.marker, "name": marker_name(self.marker), "declared_length": self.declared_length,
            "payload_length": len(self.payload) if self.size is None else self.size, "is_exif": self.is_exif, "is_xmp": self.is_xmp, "is_extended_xmp": self.is_extended_xmp,
            "is_icc": self.is_icc, "is_photoshop": self.is_photoshop,
        }


def _marker_at(data: bytes, at: int, limits: Limits) -> tuple[int, int]:
    """Marker code and the offset after it; fill bytes before the code are skipped."""
    size = len(data)
    need(at < size, "truncated JPEG: marker expected")
    if data[at] != 0xFF:
        raise ParseError(f"marker expected at offset {at}")
    code = at + 1
    while code < size and data[code] == 0xFF:
        code += 1
        need(code - at - 1 <= limits.max_jpeg_marker_fill_bytes, "too many marker fill bytes")
    need(code < size, "truncated JPEG: marker expected")
    marker = data[code]
    if marker == 0:
        raise ParseError(f"stuffed byte outside a scan at offset {at}")
    return marker, code + 1


def _payload_at(data: bytes, at: int, limits: Limits, keep: int | None = None) -> tuple[int, bytes, int]:
    size = len(data)
    need(at + 2 <= size, "truncated JPEG: segment length expected")
    length = int.from_bytes(data[at : at + 2], "big")
    if length < 2:
        raise ParseError("segment length is less than 2")
    if length - 2 > limits.max_jpeg_segment_payload_bytes:
        raise ParseError("segment payload exceeds the limit")
    if at + length > size:
        raise ParseError("truncated JPEG: segment payload is short")
    return length, data[at + 2 : at + (length if keep is None else min(length, keep + 2))], at + length


def header_walk(data: bytes, limits: Limits = DEFAULT, keep: int | None = None) -> list[Segment]:
    """SOI and all segments up to EOI or the first SOS; ``data`` may be anything that gives bytes by place.

    ``keep``: first bytes of a payload that are taken; the rest is passed over.
    """
    return header_and_end(data, limits, keep)[0]


def header_and_end(data: bytes, limits: Limits = DEFAULT, keep: int | None = None) -> tuple[list[Segment], int]:
    """``header_walk``, and where it ended."""
    size = len(data)
    need(size <= limits.max_input_file_bytes, "input file exceeds the limit")
    need(data[:2] == b"\xff\xd8", "not a JPEG: SOI is missing")
    out, at, total = [Segment(0, 0, SOI, None, b"")], 2, 0
    whole = isinstance(data, bytes) and keep is None
    while True:
        start = at
        if whole and at + 4 <= size and data[at] == 0xFF and 0 < data[at + 1] < 0xFF:
            marker, at = data[at + 1], at + 2
        else:
            marker, at = _marker_at(data, at, limits)
        need(len(out) < limits.max_jpeg_segments, "too many JPEG segments")
        if marker in (SOI, EOI, TEM) or 0xD0 <= marker <= 0xD7:
            out.append(Segment(len(out), start, marker, None, b""))
            if marker == EOI:
                return out, at
            continue
        length, payload, at = _payload_at(data, at, limits, keep)
        total += length - 2
        need(total <= limits.max_jpeg_header_payload_bytes, "JPEG header payloads exceed the limit")
        out.append(Segment(len(out), start, marker, length, payload, False, length - 2))
        if marker == SOS:
            return out, at


def dimensions(segments: list[Segment]) -> tuple[int, int]:
    """Width and height of the first frame header."""
    frame = next((s for s in segments if s.marker in SOF), None)
    need(frame is not None, "no frame header found")
    need(len(frame.payload) >= 5, "frame header is short")
    height, width = struct.unpack_from(">HH", frame.payload, 1)
    need(width > 0 and height > 0, "frame header has a zero dimension")
    return width, height


#: What a transform says of a segment: its payload, or None and a reason to drop it.
Transform = Callable[[int, bytes], tuple[bytes | None, str | None]]


@dataclass
class Rewrite:
    data: bytes
    segments: list[Segment]
    scan_sha256: str
    scan_bytes: int
    trailing: bytes
    changes: list[dict] = field(default_factory=list)
    scans: list[Segment] = field(default_factory=list)  # entropy-coded stretches, numbered by the segment before


def full_walk(data: bytes, transform: Transform | None = None, strip_trailing: bool = False, limits: Limits = DEFAULT, keep_scans: bool = False, head: tuple[list[Segment], int] | None = None) -> Rewrite:
    """The whole file, scans included; ``transform`` may change or drop APPn and COM segments.

    ``head``: what ``header_and_end`` found of the same bytes, which is then not walked again; for a walk without ``transform``.

    The scan digest is over the entropy-coded bytes of all scans with stuffed bytes, restart
    and TEM markers, in order.
    """
    need(len(data) <= limits.max_input_file_bytes, "input file exceeds the limit")
    need(data[:2] == b"\xff\xd8", "not a JPEG: SOI is missing")
    out, segments, changes, scans = [b"\xff\xd8"], [Segment(0, 0, SOI, None, b"")], [], []
    scan, scanned, saw_scan = hashlib.sha256(), 0, False
    at = 2
    known = transform is None and head is not None and head[0][-1].marker == SOS and all([s.marker != SOI for s in head[0][1:]])
    if known:
        segments, at = head[0][:-1], head[0][-1].offset
        out.append(data[2:at])
    while True:
        start = at
        marker, at = _marker_at(data, at, limits)
        need(len(segments) < limits.max_jpeg_segments * 16, "too many JPEG segments")
        if marker == EOI:
            need(saw_scan, "EOI before any scan")
            segments.append(Segment(len(segments), start, EOI, None, b"", saw_scan))
            out.append(b"\xff\xd9")
            break
        need(marker != SOI, "SOI inside the file")
        if marker == TEM or 0xD0 <= marker <= 0xD7:
            out.append(bytes((0xFF, marker)))
            segments.append(Segment(len(segments), start, marker, None, b"", saw_scan))
            continue
        length, payload, at = _payload_at(data, at, limits)
        segments.append(Segment(len(segments), start, marker, length, payload, saw_scan))
        new: bytes | None = payload
        if transform is not None and (0xE0 <= marker <= 0xEF or marker == COM):
            new, reason = transform(marker, payload)
            if new is None or new != payload:
                need(new is None or len(new) <= 65533, "a changed payload is too large")
                changes.append({"seq": len(segments) - 1, "offset": start, "marker": marker, "name": marker_name(marker), "reason": reason or "", "removed": new is None, "old_bytes": len(payload) + 4, "new_bytes": 0 if new is None else len(new) + 4})
        if new is payload or new == payload:
            out.append(data[start:at])
        elif new is not None:
            out.append(bytes((0xFF, marker)) + struct.pack(">H", len(new) + 2) + new)
        if marker != SOS:
            continue
        saw_scan, begin = True, at
        while True:
            cut = data.find(b"\xff", at)
            need(cut >= 0, "truncated JPEG: a scan has no end")
            at = cut + 1
            while at < len(data) and data[at] == 0xFF:
                at += 1
                need(at - cut <= limits.max_jpeg_marker_fill_bytes, "too many marker fill bytes")
            need(at < len(data), "truncated JPEG: a scan has no end")
            code = data[at]
            if code == 0 or code == TEM or 0xD0 <= code <= 0xD7:
                at += 1
                continue
            if code == DNL:
                chunk = data[begin:cut]
                scan.update(chunk)
                scanned += len(chunk)
                if keep_scans:
                    scans.append(Segment(len(segments) - 1, begin, SCAN, None, chunk, True))
                length, payload, end = _payload_at(data, at + 1, limits)
                segments.append(Segment(len(segments), cut, DNL, length, payload, True))
                out.append(data[begin:end])
                at = begin = end
                continue
            break
        chunk = data[begin:cut]
        scan.update(chunk)
        scanned += len(chunk)
        if keep_scans:
            scans.append(Segment(len(segments) - 1, begin, SCAN, None, chunk, True))
        out.append(chunk)
        at = cut
    trailing = data[at:]
    if trailing and not strip_trailing:
        out.append(trailing)
    elif trailing:
        changes.append({"seq": -1, "offset": at, "marker": -1, "name": "TRAILING", "reason": "trailing data after EOI", "removed": True, "old_bytes": len(trailing), "new_bytes": 0})
    return Rewrite(b"".join(out), segments, scan.hexdigest(), scanned, trailing, changes, scans)


def fingerprint(segments: list[Segment], marker: int) -> str | None:
    """SHA-256 over length-prefixed payloads of a table marker; None without any."""
    found = [s.payload for s in segments if s.marker == marker]
    return hashlib.sha256(b"".join(struct.pack(">I", len(p)) + p for p in found)).hexdigest() if found else None
