"""Many small JPEGs at a time: plain ones are read by arrays over all their bytes, any other is left to ``photo.parse``.

A file is plain if its header has only segments with lengths, its one EXIF block is sound, in order and filled in every entry, no value or directory lies over another directory, and
its scan has no markers inside. What is found of it is what ``photo.parse`` finds.
"""

from __future__ import annotations

import struct
from collections import Counter
from functools import cache, lru_cache
from hashlib import sha256

import numpy as np

from lumenlake.kernels import icc, iptc, xmp
from lumenlake.kernels.jpeg import EXIF_ID, ICC_ID, PHOTOSHOP_ID, SOF, SOI, XMP_EXT_ID, XMP_ID, Segment, marker_name
from lumenlake.kernels.limits import DEFAULT, Limits, ParseError
from lumenlake.kernels.names import EXIF, GPS, IFD0
from lumenlake.kernels.photo import PROCESSES
from lumenlake.kernels.tiff import EXIF_POINTER, GPS_POINTER, TYPES, Block, Entry, known

#: Columns that plain files have; with others all files are left to ``photo.parse``.
WALK = frozenset({"jpeg_process", "quantization", "huffman", "scan_sha256", "scan_bytes", "trailing_bytes", "presence", "exif_segments", "structural"})
COLUMNS = WALK | {"tags", "has", "has_xmp", "xmp", "has_extended_xmp", "iptc", "icc", "errors", "width", "height", "segments"}
#: Segments of a header and entries of a directory that a plain file has at most.
MOST_SEGMENTS, MOST_ENTRIES = 64, 256
#: Bytes of packets and blocks of datasets whose names are remembered.
MOST_CACHED = 4096
_GROUPS = (("IFD0", IFD0), ("ExifIFD", EXIF), ("GPS", GPS))
_SIZES = np.array([0, *[TYPES[k][1] for k in range(1, 13)]], np.int64)
_BLANK = np.isin(np.arange(256), [0, *b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "])


@cache
def _codes(group: str) -> tuple[np.ndarray, np.ndarray]:
    """Place of each tag among the group's names, -1 for those without one, and the names."""
    table = dict(_GROUPS)[group]
    places = np.full(1 << 16, -1, np.int32)
    places[list(table)] = np.arange(len(table))
    return places, np.array([f"{group}/{n}" for n in table.values()], object)


class _Bytes:
    """The bytes of all files in one array, with room to read beyond the end."""

    def __init__(self, blobs: list[bytes]):
        self.raw = np.frombuffer(b"".join([*blobs, bytes(64)]), np.uint8)

    def part(self, at: np.ndarray, n: int) -> np.ndarray:
        return self.raw[np.minimum(at, len(self.raw) - n)[:, None] + np.arange(n)]

    def number(self, at: np.ndarray, n: int, big: np.ndarray | bool) -> np.ndarray:
        found = self.part(at, n).view(f"<u{n}")[:, 0]
        return np.where(big, found.byteswap(), found).astype(np.int64)

    def starts(self, at: np.ndarray, size: np.ndarray, prefix: bytes) -> np.ndarray:
        return (size >= len(prefix)) & (self.part(at, len(prefix)) == np.frombuffer(prefix, np.uint8)).all(1)

    def spread(self, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the stretches, and place of, each of their bytes."""
        of = np.repeat(np.arange(len(at)), size)
        return of, at[of] + np.arange(len(of)) - (np.cumsum(size) - size)[of]


def _headers(b: _Bytes, start: np.ndarray, end: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, ...]:
    """File, marker, place and size of payload of all segments, by file and place, and where each header ends; files that are not plain are struck."""
    plain &= (end - start >= 4) & (b.number(start, 2, True) == 0xFFD8)
    at, todo, found = start + 2, np.flatnonzero(plain), []
    for _ in range(MOST_SEGMENTS):
        p = at[todo]
        head = b.part(p, 4).astype(np.int64)
        marker, size = head[:, 1], head[:, 2] << 8 | head[:, 3]
        good = (head[:, 0] == 0xFF) & (marker >= 0xC0) & (marker < 0xFF) & ((marker < 0xD0) | (marker > 0xD9) | (marker == 0xDA)) & (size >= 2) & (p + 2 + size <= end[todo])
        plain[todo[~good]] = False
        todo, p, marker, size = todo[good], p[good], marker[good], size[good]
        found.append((todo, marker, p + 4, size - 2))
        at[todo] = p + 2 + size
        todo = todo[marker != 0xDA]
        if not len(todo):
            break
    plain[todo] = False
    of, marker, place, size = (np.concatenate(x) for x in zip(*found))
    by = np.argsort(of, kind="stable")
    by = by[plain[of[by]]]
    return of[by], marker[by], place[by], size[by], at


def _entries(b: _Bytes, file: np.ndarray, at: np.ndarray, size: np.ndarray, big: np.ndarray, offset: np.ndarray, group: str, plain: np.ndarray) -> tuple[np.ndarray, ...]:
    """File, its row in ``file``, tag, type, count, place of the eight bytes before the value, value's number and place in the names, of all entries of one directory a file."""
    count = np.where(offset + 2 <= size, b.number(at + offset, 2, big), MOST_ENTRIES + 1)
    good = (offset >= 8) & (count <= MOST_ENTRIES) & (offset + 2 + 12 * count + 4 <= size)
    good &= b.number(np.where(good, at + offset + 2 + 12 * count, at), 4, big) == 0  # no next directory
    plain[file[~good]] = False
    count = np.where(good, count, 0)
    of = np.repeat(np.arange(len(file)), count)
    place = (at + offset + 2)[of] + 12 * (np.arange(len(of)) - (np.cumsum(count) - count)[of])
    order = big[of]
    tag, kind, n, value = b.number(place, 2, order), b.number(place + 2, 2, order), b.number(place + 4, 4, order), b.number(place + 8, 4, order)
    bytes_ = _SIZES[np.where(kind <= 12, kind, 0)] * n
    name = _codes(group)[0][tag]
    rising = np.ones(len(of), bool)
    rising[1:] = (of[1:] != of[:-1]) | (tag[1:] > tag[:-1])
    good = (bytes_ > 0) & (n <= 65536) & (name >= 0) & rising & ((bytes_ <= 4) | (value >= 8) & (value + bytes_ <= size[of]))
    good &= (bytes_ <= 4) | (value >= (offset + 2 + 12 * count + 4)[of]) | (value + bytes_ <= offset[of])
    stands = np.where(bytes_ > 4, at[of] + value, place + 8)
    text = np.flatnonzero(good & (kind == 2))
    e, p = b.spread(stands[text], bytes_[text])
    good[text[e[b.raw[p] >= 0x80]]] = False
    good[text[np.bincount(e[~_BLANK[b.raw[p]]], minlength=len(text)) == 0]] = False
    pairs = np.flatnonzero(good & ((kind == 5) | (kind == 10)))
    e = np.repeat(np.arange(len(pairs)), n[pairs])
    p = stands[pairs][e] + 8 * (np.arange(len(e)) - (np.cumsum(n[pairs]) - n[pairs])[e])
    good[pairs[e[b.number(p + 4, 4, False) == 0]]] = False
    pointer = np.isin(tag, (EXIF_POINTER, GPS_POINTER)) if group == "IFD0" else np.zeros(len(tag), bool)
    good &= ~pointer | (kind == 4) & (n == 1)
    plain[file[of[~good]]] = False
    return file[of], of, tag, kind, n, place, value, name


def parse_many(blobs: list[bytes], wanted: frozenset[str], limits: Limits = DEFAULT, only: frozenset[str] | None = None, values: bool = True) -> list[dict | None]:
    """``photo.parse`` of each plain file, columns beyond ``wanted`` left out; None for any other."""
    if not blobs or limits != DEFAULT or not wanted <= COLUMNS:
        return [None] * len(blobs)
    ends = np.cumsum([len(x) for x in blobs])
    start, end, plain = np.concatenate([[0], ends[:-1]]), ends, np.ones(len(blobs), bool)
    b = _Bytes(blobs)
    of, marker, place, size, after = _headers(b, start, end, plain)
    app1, kinds = marker == 0xE1, {}
    for name, mark, prefix in (("exif", 0xE1, EXIF_ID), ("xmp", 0xE1, XMP_ID), ("more", 0xE1, XMP_EXT_ID), ("icc", 0xE2, ICC_ID), ("iptc", 0xED, PHOTOSHOP_ID)):
        some = np.flatnonzero(app1 if mark == 0xE1 else marker == mark)
        kinds[name] = some[b.starts(place[some], size[some], prefix)]
    plain[of[kinds["more"]]] = False
    block = kinds["exif"]
    plain[np.bincount(of[block], minlength=len(blobs)) > 1] = False
    frames = np.flatnonzero(np.isin(marker, sorted(SOF)))
    frames = frames[np.unique(of[frames], return_index=True)[1]]
    height, width = b.number(place[frames] + 1, 2, True), b.number(place[frames] + 3, 2, True)
    framed = np.zeros(len(blobs), bool)
    framed[of[frames[(size[frames] >= 5) & (height > 0) & (width > 0)]]] = True
    plain &= framed

    exif, origin, order = {g: None for g, _ in _GROUPS}, np.zeros(len(blobs), np.int64), np.zeros(len(blobs), bool)
    block = block[plain[of[block]]]
    if not wanted.isdisjoint({"tags", "has", "presence", "structural"}):
        file, at, length = of[block], place[block] + 6, size[block] - 6
        head = b.part(at, 4)
        big = head[:, 0] == 0x4D
        ends_ = np.where(big[:, None], np.frombuffer(b"MM\0*", np.uint8), np.frombuffer(b"II*\0", np.uint8))
        good = (length >= 8) & (head == ends_).all(1)
        plain[file[~good]] = False
        file, at, length, big = file[good], at[good], length[good], big[good]
        origin[file], order[file] = at - start[file], big
        first = b.number(at + 4, 4, big)
        exif["IFD0"] = top = _entries(b, file, at, length, big, first, "IFD0", plain)
        seen, last = [first], first + 2 + 12 * np.bincount(top[1], minlength=len(file)) + 4
        for group, pointer in (("ExifIFD", EXIF_POINTER), ("GPS", GPS_POINTER)):
            some = top[2] == pointer
            row, offset = top[1][some], top[6][some]
            places = np.full(len(file), -1)
            places[row] = offset
            for other in seen:
                plain[file[(places == other) & (places >= 0)]] = False  # a directory entered twice
            plain[file[(places >= first) & (places < last)]] = False
            seen.append(places)
            exif[group] = _entries(b, file[row], at[row], length[row], big[row], offset, group, plain)

    out: list[dict | None] = [{"errors": []} if p else None for p in plain.tolist()]
    rows = lambda found: [(i, blobs[i], p - s, n) for i, p, n, s in zip(of[found].tolist(), place[found].tolist(), size[found].tolist(), start[of[found]].tolist()) if out[i] is not None]
    for i, w, h, m in zip(of[frames].tolist(), width.tolist(), height.tolist(), marker[frames].tolist()):
        if out[i] is not None:
            out[i] |= {"width": w, "height": h, "jpeg_process": PROCESSES[m], "xmp": [], "iptc": [], "icc": None, "has": [], "has_xmp": [], "tags": []}
            out[i] |= {"segments": [], "has_extended_xmp": False, "exif_segments": 0, "structural": []}
    for i in of[block].tolist():
        if out[i] is not None:
            out[i]["exif_segments"] = 1
    if "segments" in wanted:
        _segments(out, of, marker, place - start[of], size, {f"is_{k}": v for k, v in (("exif", kinds["exif"]), ("xmp", kinds["xmp"]), ("icc", kinds["icc"]), ("photoshop", kinds["iptc"]))})
    for group, found in exif.items():
        if found is None:
            continue
        if "has" in wanted:
            names, bounds = _codes(group)[1][found[7]].tolist(), np.searchsorted(found[0], np.arange(len(blobs) + 1)).tolist()
            for i, x in enumerate(out):
                if x is not None:
                    x["has"] += names[bounds[i] : bounds[i + 1]]
        if "tags" in wanted:
            _tags(out, blobs, group, found, only, values, origin, order, start)
    packets: Counter = Counter()
    for i, data, p, n in rows(kinds["xmp"]) if "xmp" in wanted else ():
        try:
            found = xmp.properties(data[p + len(XMP_ID) : p + n], limits)
        except ParseError:
            out[i] = None
        if out[i] is not None:
            out[i]["xmp"] += [{"packet": packets[i]} | x for x in found]
            packets[i] += 1
    for i, data, p, n in rows(kinds["xmp"]) if "has_xmp" in wanted else ():
        if out[i] is not None:
            packet = data[p + len(XMP_ID) : p + n]
            try:
                found = xmp.names_filled(packet, limits) if len(packet) <= MOST_CACHED else xmp.filled(xmp.properties(packet, limits))
            except ParseError:
                out[i] = None
                continue
            out[i]["has_xmp"] = list(dict.fromkeys([*out[i]["has_xmp"], *found]))
    photoshop = rows(kinds["iptc"]) if not wanted.isdisjoint({"has", "iptc", "presence"}) else []
    datasets: dict[int, bool] = {}
    for i, data, p, n in photoshop:
        try:
            if "iptc" in wanted or n > MOST_CACHED:
                found = iptc.rows(data[p : p + n], limits)
                names = None if found is None else iptc.filled(found)
            else:
                found, names = [], iptc.names_filled(data[p : p + n], limits)
        except (ParseError, struct.error):
            names = None
        if names is None or i in datasets:
            out[i] = None
            continue
        datasets[i] = True
        if out[i] is not None:
            out[i]["iptc"] = found
            out[i]["has"] += names
    chunks: dict[int, list[bytes]] = {}
    for i, data, p, n in rows(kinds["icc"]) if "icc" in wanted else ():
        chunks.setdefault(i, []).append(data[p : p + n])
    for i, found in chunks.items():
        try:
            profile = icc.parse(icc.reassemble(found, limits), limits)
        except (ParseError, struct.error):
            out[i] = None
        if out[i] is not None:
            out[i]["icc"] = profile
    if not wanted.isdisjoint(WALK):
        _walks(out, blobs, (after - start).tolist())
        tables: dict[int, dict[int, list[bytes]]] = {0xDB: {}, 0xC4: {}}
        for mark, by in tables.items():
            for i, data, p, n in rows(np.flatnonzero(marker == mark)):
                by.setdefault(i, []).append(n.to_bytes(4, "big") + data[p : p + n])
        marks = {k: set(of[v].tolist()) for k, v in kinds.items()} if "presence" in wanted else {}
        gps, models = set(), {}
        if (top := exif["IFD0"]) is not None:
            gps = set(top[0][top[2] == GPS_POINTER].tolist())
            some, first_byte, tiff_at = top[2] == 0x0110, start.tolist(), origin.tolist()
            for i, kind, n, p, v in zip(*[x[some].tolist() for x in (top[0], top[3], top[4], top[5], top[6])]):
                at = p + 8 - first_byte[i] if n <= 4 else v + tiff_at[i]
                if kind == 2 and out[i] is not None:
                    models[i] = blobs[i][at : at + n].rstrip(b"\0").decode("ascii").strip() or None
        yes = lambda found: "YES" if found else "NO"
        for i, x in enumerate(out):
            if x is not None:
                for mark, name in ((0xDB, "quantization"), (0xC4, "huffman")):
                    found = tables[mark].get(i)
                    x[name] = _digest(b"".join(found)) if found else None
                if marks:
                    x["presence"] = {
                        "exif": yes(i in marks["exif"]), "gps": yes(i in gps), "xmp": yes(i in marks["xmp"]), "iptc": yes(i in datasets), "icc": yes(i in marks["icc"]),
                        "camera_model": models.get(i), "warnings": [],
                    }
    return out


@lru_cache(256)
def _digest(tables: bytes) -> str:
    """Of tables, which many files share."""
    return sha256(tables).hexdigest()


def _walks(out: list[dict | None], blobs: list[bytes], after: list[int]) -> None:
    """Scan and what follows it."""
    for i, (x, data, at) in enumerate(zip(out, blobs, after)):
        if x is not None:
            cut = data.find(b"\xff", at)
            if cut < 0 or data[cut + 1 : cut + 2] != b"\xd9":
                out[i] = None
            else:
                x["scan_sha256"], x["scan_bytes"], x["trailing_bytes"] = sha256(data[at:cut]).hexdigest(), cut - at, len(data) - cut - 2


def _segments(out: list[dict | None], of: np.ndarray, marker: np.ndarray, place: np.ndarray, size: np.ndarray, flags: dict[str, np.ndarray]) -> None:
    """Rows of the segments of each header, as ``Segment.row`` makes them."""
    first = Segment(0, 0, SOI, None, b"").row()
    is_ = np.zeros(len(of), np.int64)
    for k, found in enumerate(flags.values()):
        is_[found] |= 1 << k
    blank = {k: False for k in first if k.startswith("is_")}
    kinds = [blank | {name: bool(x >> k & 1) for k, name in enumerate(flags)} for x in range(1 << len(flags))]
    for i, m, p, n, x in zip(of.tolist(), marker.tolist(), place.tolist(), size.tolist(), is_.tolist()):
        if (row := out[i]) is not None:
            rows = row["segments"] or [first.copy()]
            rows.append({"seq": len(rows), "offset": p - 4, "marker": m, "name": marker_name(m), "declared_length": n + 2, "payload_length": n, **kinds[x]})
            row["segments"] = rows


def _tags(
    out: list[dict | None], blobs: list[bytes], group: str, found: tuple[np.ndarray, ...], only: frozenset[str] | None, values: bool, origin: np.ndarray, order: np.ndarray, start: np.ndarray
) -> None:
    """Rows of the entries of a directory, as ``Block.tagged_rows`` makes them."""
    file, row, place, name = found[0], found[1], found[5], found[7]
    pos = np.arange(len(row)) - np.searchsorted(row, row)
    some = np.arange(len(row)) if only is None else np.flatnonzero(np.isin(name, [k for k, x in enumerate(_codes(group)[1]) if x in only]))
    origins, orders = origin.tolist(), [">" if x else "<" for x in order.tolist()]
    for i, k, p in zip(file[some].tolist(), pos[some].tolist(), (place[some] - start[file[some]]).tolist()):
        if out[i] is None:
            continue
        data = blobs[i]
        e = known(orders[i], group, data[p : p + 8])
        made = e.row.copy()
        made["pos"] = k
        if values:
            made["value"] = Block(data[origins[i] :], orders[i], 0).union(Entry(made["tag"], e.type, e.count, data[p + 8 : p + 12], 0))
        out[i]["tags"].append(made)
