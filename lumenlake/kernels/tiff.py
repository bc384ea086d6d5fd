"""TIFF structures inside EXIF: header, directories, values."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache
from math import gcd
from typing import NamedTuple

from lumenlake.kernels import names
from lumenlake.kernels.limits import DEFAULT, Limits, ParseError, need

#: Field types, their names and component sizes.
TYPES = {
    1: ("BYTE", 1), 2: ("ASCII", 1), 3: ("SHORT", 2), 4: ("LONG", 4), 5: ("RATIONAL", 8), 6: ("SBYTE", 1),
    7: ("UNDEFINED", 1), 8: ("SSHORT", 2), 9: ("SLONG", 4), 10: ("SRATIONAL", 8), 11: ("FLOAT", 4), 12: ("DOUBLE", 8),
}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
EXIF_POINTER, GPS_POINTER = 0x8769, 0x8825
_ENTRIES, _LONG, _SHORT = ({o: struct.Struct(o + f) for o in "<>"} for f in ("HHI4s", "I", "H"))
_HEADS = struct.Struct("8s4s")


class Entry(NamedTuple):
    tag: int
    type: int
    count: int
    raw: bytes
    at: int  # offset of the entry


@dataclass(slots=True)
class Directory:
    offset: int
    body: bytes  # its entries as they stand
    order: str
    next: int

    @property
    def end(self) -> int:
        return self.offset + 2 + len(self.body) + 4

    @property
    def entries(self) -> tuple[Entry, ...]:
        at = range(self.offset + 2, self.end, 12)
        return tuple([Entry(*x, k) for x, k in zip(_ENTRIES[self.order].iter_unpack(self.body), at)])

    def find(self, tag: int) -> Entry | None:
        """The first entry of a tag."""
        code = _SHORT[self.order].pack(tag)
        for k in range(0, len(self.body), 12):
            if self.body.startswith(code, k):
                return Entry(*_ENTRIES[self.order].unpack_from(self.body, k), self.offset + 2 + k)
        return None


class Known(NamedTuple):
    """What an entry's first eight bytes say."""

    type: int
    count: int
    size: int  # -1 where the type is none
    name: str  # with its group
    row: dict  # without place and value


@lru_cache(1 << 14)
def known(order: str, ifd: str, head: bytes) -> Known:
    tag, kind, count = struct.unpack(order + "HHI", head)
    named, name = (TYPES[kind][0] if kind in TYPES else f"UNKNOWN_{kind}"), names.tag_name(ifd, tag)
    row = {"ifd": ifd, "pos": None, "tag": tag, "tag_name": name, "field_type": kind, "field_type_name": named, "count": count, "value": None}
    return Known(kind, count, TYPES[kind][1] * count if kind in TYPES else -1, f"{ifd}/{name}", row)


@dataclass
class Block:
    """A TIFF block and the state of walking it: directories are never entered twice."""

    data: bytes
    order: str
    first: int
    limits: Limits = DEFAULT
    seen: tuple[int, ...] = ()

    @staticmethod
    def open(data: bytes, limits: Limits = DEFAULT) -> Block:
        need(len(data) >= 8, "TIFF header is short")
        order = {b"II": "<", b"MM": ">"}.get(data[:2])
        need(order is not None, "unknown TIFF byte order")
        magic, first = struct.unpack_from(order + "HI", data, 2)
        need(magic == 42, "TIFF magic is not 42")
        return Block(data, order, first, limits)

    def directory(self, offset: int, depth: int = 0) -> Directory:
        limits, data = self.limits, self.data
        need(depth <= limits.max_ifd_depth, "directories are nested too deep")
        if offset in self.seen:
            raise ParseError(f"circular directory reference at {offset}")
        self.seen += (offset,)
        need(len(self.seen) <= limits.max_ifd_nodes, "too many directories")
        if not (offset >= 8 and offset + 2 <= len(data)):
            raise ParseError(f"directory offset {offset} is outside the data")
        (count,) = _SHORT[self.order].unpack_from(data, offset)
        need(count <= limits.max_ifd_entries, "too many directory entries")
        end = offset + 2 + 12 * count + 4
        need(end <= len(data), "directory exceeds the data")
        (following,) = _LONG[self.order].unpack_from(data, end - 4)
        need(following == 0 or following != offset and 8 <= following and following + 2 <= len(data), "next directory offset is invalid")
        return Directory(offset, data[offset + 2 : end - 4], self.order, following)

    def size(self, e: Entry) -> int:
        if e.type not in TYPES:
            raise ParseError(f"unsupported field type {e.type}")
        return TYPES[e.type][1] * e.count

    def pointer(self, e: Entry) -> int:
        return _LONG[self.order].unpack(e.raw)[0]

    def raw(self, e: Entry) -> bytes:
        size = self.size(e)
        if e.count > self.limits.max_tiff_components:
            raise ParseError("too many components")
        if size > self.limits.max_tiff_value_bytes:
            raise ParseError("value is too large")
        if size <= 4:
            return e.raw[:size]
        at = self.pointer(e)
        if at < 8 or at + size > len(self.data):
            raise ParseError("value lies outside the data")
        return self.data[at : at + size]

    def _text(self, raw: bytes) -> str:
        try:
            return raw.rstrip(b"\0").decode("ascii")
        except UnicodeDecodeError:
            raise ParseError("text is not ASCII") from None

    def _pairs(self, e: Entry, raw: bytes) -> tuple[int, ...]:
        pairs = struct.unpack(f"{self.order}{2 * e.count}{'I' if e.type == 5 else 'i'}", raw)
        need(0 not in pairs[1::2], "rational with a zero denominator")
        return pairs

    def value(self, e: Entry):
        """A scalar for count 1, else a tuple; text and bytes as they are."""
        raw = self.raw(e)
        if e.type == 2:
            return self._text(raw)
        if e.type == 7:
            return raw
        if e.type in (5, 10):
            pairs = self._pairs(e, raw)
            values = tuple(Fraction(a, b) for a, b in zip(pairs[::2], pairs[1::2]))
        else:
            values = struct.unpack(f"{self.order}{e.count}{_CODES[e.type]}", raw)
        return values[0] if e.count == 1 else values

    def filled(self, e: Entry) -> bool:
        """``has_value`` of the entry's value, and what ``value`` raises, without numbers made of it."""
        raw = self.raw(e)
        if e.type == 2:
            return bool(self._text(raw).strip())
        if e.type in (5, 10):
            self._pairs(e, raw)
        return bool(raw)

    def union(self, e: Entry) -> dict:
        """``tagged`` of the entry's value."""
        if e.type == 2:
            return {"kind": "text", "is_scalar": True, "ints": None, "rationals": None, "floats": None, "text": self._text(self.raw(e)), "bytes": None}
        if e.type not in (5, 10):
            return tagged(self.value(e))
        pairs = self._pairs(e, self.raw(e))
        if not pairs:
            return tagged(())
        out = []
        for a, b in zip(pairs[::2], pairs[1::2]):
            g = gcd(a, b) if b > 0 else -gcd(a, b)
            out.append({"num": a // g, "den": b // g})
        return {"kind": "rational", "is_scalar": e.count == 1, "ints": None, "rationals": out, "floats": None, "text": None, "bytes": None}

    def child(self, parent: Directory, tag: int, depth: int = 1) -> Directory | None:
        """The directory that the first entry of ``tag`` points to."""
        e = parent.find(tag)
        if e is None:
            return None
        at = self.value(e)
        need(isinstance(at, int), f"pointer {tag:04X} is not an integer offset")
        return self.directory(at, depth)

    def decode(self, d: Directory, ifd: str) -> list[dict]:
        """All entries as rows; one that cannot be decoded fails the directory."""
        return [self.entry_row(e, ifd, k, self.value(e)) for k, e in enumerate(d.entries)]

    def tagged_rows(self, d: Directory, ifd: str, only: frozenset[str] | None = None, values: bool = True) -> list[dict]:
        """The rows of ``decode`` with values as ``tagged`` makes them, or without; of all entries or of those named ``only``. All must be sound."""
        out = []
        for k, (head, raw) in enumerate(_HEADS.iter_unpack(d.body)):
            e = known(self.order, ifd, head)
            if only is not None and e.name not in only:
                self._has(e, raw)
                continue
            row = e.row.copy()
            row["pos"] = k
            if values:
                row["value"] = self.union(Entry(row["tag"], e.type, e.count, raw, 0))
            else:
                self._has(e, raw)
            out.append(row)
        return out

    def _has(self, e: Known, raw: bytes) -> bool:
        """``filled`` of an entry by its two parts."""
        kind, size = e.type, e.size
        if size < 0:
            raise ParseError(f"unsupported field type {kind}")
        if e.count > self.limits.max_tiff_components:
            raise ParseError("too many components")
        if size > self.limits.max_tiff_value_bytes:
            raise ParseError("value is too large")
        if size > 4:
            (at,) = _LONG[self.order].unpack(raw)
            if at < 8 or at + size > len(self.data):
                raise ParseError("value lies outside the data")
            if kind == 2:
                return bool(self._text(self.data[at : at + size]).strip())
            if kind == 5 or kind == 10:
                for k in range(at + 4, at + size, 8):
                    if self.data.startswith(b"\0\0\0\0", k):
                        raise ParseError("rational with a zero denominator")
            return True
        return bool(self._text(raw[:size]).strip()) if kind == 2 else size > 0

    def names_filled(self, d: Directory, ifd: str) -> dict[str, bool]:
        """Whether the last entry of each name, with its group, has a value; one that cannot be decoded fails the directory."""
        return {(e := known(self.order, ifd, head)).name: self._has(e, raw) for head, raw in _HEADS.iter_unpack(d.body)}

    def entry_row(self, e: Entry, ifd: str, pos: int, value) -> dict:
        kind = TYPES[e.type][0] if e.type in TYPES else f"UNKNOWN_{e.type}"
        return {"ifd": ifd, "pos": pos, "tag": e.tag, "tag_name": names.tag_name(ifd, e.tag), "field_type": e.type, "field_type_name": kind, "count": e.count, "value": value}


def has_value(value) -> bool:
    """Present and not blank or empty; zero is present."""
    if value is None:
        return False
    if isinstance(value, str):
        return bool(value.strip())
    return bool(len(value)) if isinstance(value, (bytes, tuple, list)) else True


def tagged(value) -> dict:
    """A union-typed value as one struct: kind, is_scalar and the array, text or bytes that holds it."""
    out = {"kind": "none", "is_scalar": True, "ints": None, "rationals": None, "floats": None, "text": None, "bytes": None}
    if value is None:
        return out
    if isinstance(value, str):
        return out | {"kind": "text", "text": value}
    if isinstance(value, bytes):
        return out | {"kind": "bytes", "bytes": value}
    many = isinstance(value, tuple)
    values = value if many else (value,)
    out["is_scalar"] = not many
    if any(isinstance(v, Fraction) for v in values):
        return out | {"kind": "rational", "rationals": [{"num": v.numerator, "den": v.denominator} for v in map(Fraction, values)]}
    if any(isinstance(v, float) for v in values):
        return out | {"kind": "float", "floats": [float(v) for v in values]}
    return out | {"kind": "int", "ints": [int(v) for v in values]}


def union_filled(v: dict) -> bool:
    """``has_value`` of what ``tagged`` made."""
    if v["kind"] == "text":
        return bool(v["text"].strip())
    if v["kind"] == "bytes":
        return bool(v["bytes"])
    return v["kind"] != "none" and bool(v["is_scalar"] or v["ints"] or v["rationals"] or v["floats"])
