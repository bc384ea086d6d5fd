"""Encoders: well-formed blobs from values, for fixtures and for queries over tables without images."""

from __future__ import annotations

import struct
from collections.abc import Callable
from functools import cache, lru_cache
from operator import itemgetter

from lumenlake.kernels.icc import ICC_ID
from lumenlake.kernels.jpeg import EXIF_ID, PHOTOSHOP_ID, XMP_ID
from lumenlake.kernels.tiff import EXIF_POINTER, GPS_POINTER

_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
#: An entry to encode: tag, field type, value (text, bytes, numbers, or (num, den) pairs).
Field = tuple[int, int, object]


def segment(marker: int, payload: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(payload) + 2) + payload


_FRAME = struct.Struct(">BBHBHHB3s")


@cache
def _table(q: int) -> bytes:
    """The segment of a quantisation table of one value, which is a byte."""
    return segment(0xDB, b"\0" + bytes([q]) * 64)


def jpeg(parts: list[bytes], width: int, height: int, scan: bytes = b"\x11\x22\x33", q: int = 5, sof: int = 0xC0, trailing: bytes = b"") -> bytes:
    """SOI, the given segments, one quantisation table, a one-component frame, a scan and EOI."""
    frame = _FRAME.pack(0xFF, sof, 11, 8, height, width, 1, b"\x01\x11\x00")
    return b"".join([b"\xff\xd8", *parts, _table(q), frame, b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00", scan, b"\xff\xd9", trailing])


_packer = cache(struct.Struct)


def _encode(order: str, kind: int, value: object) -> tuple[int, bytes]:
    if kind == 2:
        raw = str(value).encode("ascii", "replace") + b"\0"
        return len(raw), raw
    if kind == 7:
        return len(value), bytes(value)
    if kind in (5, 10):
        values = value if value and not isinstance(value[0], int) else [value] if value else value
        numbers = [x for a, b in values for x in (a, b)]
        return len(values), _packer(f"{order}{len(numbers)}{'I' if kind == 5 else 'i'}").pack(*numbers)
    if isinstance(value, (list, tuple)):
        return len(value), _packer(f"{order}{len(value)}{_CODES[kind]}").pack(*value)
    return 1, _packer(order + _CODES[kind]).pack(value)


#: A field's tag, type, count and bytes.
Encoded = tuple[int, int, int, bytes]


def _encoded(order: str, fields: list[Field]) -> list[Encoded]:
    return [(tag, kind, *_encode(order, kind, value)) for tag, kind, value in fields]


def _length(fields: list[Encoded]) -> int:
    """Bytes of a directory and its external values."""
    return 6 + 12 * len(fields) + sum([len(raw) + len(raw) % 2 for _, _, _, raw in fields if len(raw) > 4])


def _directory(order: str, fields: list[Encoded], at: int) -> bytes:
    """A directory at offset ``at`` and its external values after it."""
    parts, tail = [len(fields)], []
    end = at + 2 + 12 * len(fields) + 4
    pointer = _packer(order + "I").pack
    for tag, kind, n, raw in fields:
        if len(raw) <= 4:
            parts += (tag, kind, n, raw)  # filled with zeros
        else:
            parts += (tag, kind, n, pointer(end))
            padded = raw + b"\0" if len(raw) % 2 else raw
            tail.append(padded)
            end += len(padded)
    return b"".join([_packer(order + "H" + "HHI4s" * len(fields) + "4x").pack(*parts), *tail])


def tiff(ifd0: list[Field], exif: list[Field] | None = None, gps: list[Field] | None = None, big_endian: bool = False) -> bytes:
    order = ">" if big_endian else "<"
    placed, subs = _encoded(order, ifd0), [(tag, _encoded(order, sub)) for tag, sub in ((EXIF_POINTER, exif), (GPS_POINTER, gps)) if sub is not None]
    at, made = 8 + _length(placed) + 12 * len(subs), []
    for tag, sub in subs:
        placed.append((tag, 4, 1, _packer(order + "I").pack(at)))
        made.append(_directory(order, sub, at))
        at += len(made[-1])
    return b"".join([b"MM" if big_endian else b"II", _packer(order + "HI").pack(42, 8), _directory(order, placed, 8), *made])


def exif(*args, **kwargs) -> bytes:
    return segment(0xE1, EXIF_ID + tiff(*args, **kwargs))


#: Tag, type and count of each field of a directory.
Shape = tuple[tuple[int, int, int], ...]
_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


@lru_cache(65536)
def exif_of(big_endian: bool, ifd0: Shape, exif: Shape | None = None, gps: Shape | None = None) -> Callable[[list], bytes]:
    """What makes the segment of ``exif`` from the plain values of all fields in order: bytes of texts (their ends are added), numbers, a fraction's two numbers."""
    order, subs = ">" if big_endian else "<", [(tag, sub) for tag, sub in ((EXIF_POINTER, exif), (GPS_POINTER, gps)) if sub is not None]
    padded = lambda shape: [n + n % 2 for n in (_BYTES[k] * c for _, k, c in shape) if n > 4]
    length = lambda shape: 6 + 12 * len(shape) + sum(padded(shape))
    at, placed = 8 + length(ifd0) + 12 * len(subs), []
    directories = [(8, ifd0, placed)]
    for tag, sub in subs:
        placed.append(struct.pack(order + "HHII", tag, 4, 1, at))
        directories.append((at, sub, []))
        at += length(sub)
    parts: list[tuple[str, bytes | int]] = [("s", struct.pack(">BBH", 0xFF, 0xE1, len(EXIF_ID) + at + 2) + EXIF_ID), ("s", (b"MM" if big_endian else b"II") + struct.pack(order + "HI", 42, 8))]
    given = 0  # values so far
    for start, shape, pointers in directories:
        end, tail = start + 6 + 12 * (len(shape) + len(pointers)), []
        parts.append(("s", struct.pack(order + "H", len(shape) + len(pointers))))
        for tag, kind, count in shape:
            size = _BYTES[kind] * count
            n = 1 if kind in (2, 7) else 2 * count if kind in (5, 10) else count
            wide = 4 if size <= 4 else size + size % 2
            code = f"{wide}s" if kind in (2, 7) else f"{n}{'I' if kind == 5 else 'i' if kind == 10 else _CODES[kind]}{wide - size}x"
            values = [(code if k == 0 else "", given + k) for k in range(n)]
            given += n
            parts.append(("s", struct.pack(order + "HHI", tag, kind, count)))
            if size <= 4:
                parts += values
            else:
                parts.append(("s", struct.pack(order + "I", end)))
                tail += values
                end += wide
        parts += [("s", p) for p in (*pointers, bytes(4))]
        parts += tail
    codes, fixed, places = [], [], []
    for code, x in parts:
        if isinstance(x, int):
            codes.append(code)
            places.append(x)
        elif places and places[-1] >= given:  # neighbours in one
            fixed[-1] += x
            codes[-1] = f"{len(fixed[-1])}s"
        else:
            places.append(given + len(fixed))
            fixed.append(x)
            codes.append(f"{len(x)}s")
    pack, pick = struct.Struct(order + "".join(codes)).pack, itemgetter(*places)
    return lambda values: pack(*pick(values + fixed))


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def xmp_packet(attributes: dict[str, str], lists: dict[str, list[str]] | None = None, titles: dict[str, str] | None = None) -> bytes:
    """Attributes by qualified name, sequences by qualified name, and dc:title by language."""
    spaces = {"xmp": "http://ns.adobe.com/xap/1.0/", "dc": "http://purl.org/dc/elements/1.1/", "exif": "http://ns.adobe.com/exif/1.0/", "photoshop": "http://ns.adobe.com/photoshop/1.0/"}
    attrs = "".join(f' {k}="{_escape(v)}"' for k, v in attributes.items())
    seqs = "".join(f"<{k}><rdf:Seq>{''.join(f'<rdf:li>{_escape(x)}</rdf:li>' for x in v)}</rdf:Seq></{k}>" for k, v in (lists or {}).items())
    alt = "".join(f'<rdf:li xml:lang="{k}">{_escape(v)}</rdf:li>' for k, v in (titles or {}).items())
    alt = f"<dc:title><rdf:Alt>{alt}</rdf:Alt></dc:title>" if alt else ""
    names = "".join(f' xmlns:{k}="{v}"' for k, v in spaces.items())
    return (
        f'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">'
        f'<rdf:Description rdf:about=""{names}{attrs}>{seqs}{alt}</rdf:Description></rdf:RDF></x:xmpmeta>'
    ).encode()


def xmp(*args, **kwargs) -> bytes:
    return segment(0xE1, XMP_ID + xmp_packet(*args, **kwargs))


def iptc(sets: list[tuple[int, int, bytes]], others: list[tuple[int, bytes]] | None = None) -> bytes:
    data = b"".join(struct.pack(">BBBH", 0x1C, r, n, len(v)) + v for r, n, v in sets)
    blocks = [*(others or []), (0x0404, data)]
    body = b"".join(b"8BIM" + struct.pack(">H", rid) + b"\0\0" + struct.pack(">I", len(d)) + d + b"\0" * (len(d) % 2) for rid, d in blocks)
    return segment(0xED, PHOTOSHOP_ID + body)


def icc_profile(name: str, space: bytes = b"RGB ", kind: bytes = b"mntr", localized: bool = False) -> bytes:
    if localized:
        text = name.encode("utf-16-be")
        desc = b"mluc" + bytes(4) + struct.pack(">II", 1, 12) + b"enUS" + struct.pack(">II", len(text), 28) + text
    else:
        raw = name.encode("latin-1", "replace") + b"\0"
        desc = b"desc" + bytes(4) + struct.pack(">I", len(raw)) + raw
    head = bytearray(128)
    head[4:8], head[8:10], head[12:16], head[16:20], head[20:24], head[36:40], head[40:44] = b"TEST", b"\x04\x30", kind, space, b"XYZ ", b"acsp", b"APPL"
    body = struct.pack(">I4sII", 1, b"desc", 144, len(desc)) + desc
    head[:4] = struct.pack(">I", 128 + len(body))
    return bytes(head) + body


def icc(profile: bytes, chunks: int = 1) -> list[bytes]:
    step = -(-len(profile) // chunks)
    return [segment(0xE2, ICC_ID + bytes((k + 1, chunks)) + profile[k * step : (k + 1) * step]) for k in range(chunks)]


def ftyp(major: bytes, compatible: list[bytes]) -> bytes:
    return struct.pack(">I", 16 + 4 * len(compatible)) + b"ftyp" + major + bytes(4) + b"".join(compatible)
