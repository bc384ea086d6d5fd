"""Blob to blob: removal of all metadata, of locations, or of private fields."""

from __future__ import annotations

import struct

from lumenlake.kernels import iptc, xmp
from lumenlake.kernels.jpeg import COM, EXIF_ID, ICC_ID, PHOTOSHOP_ID, XMP_EXT_ID, XMP_ID, Rewrite, full_walk
from lumenlake.kernels.limits import DEFAULT, Limits, need
from lumenlake.kernels.tiff import EXIF_POINTER, GPS_POINTER, TYPES, Block, Directory, Entry

#: What the privacy mode redacts.
IFD0_TAGS = frozenset({0x0110, 0x0131, 0x013B, 0x8298})
EXIF_TAGS = frozenset({0x9003, 0xA420, 0xA430, 0xA431, 0xA435})
IPTC_SETS = frozenset({(2, 55), (2, 60), (2, 80), (2, 85), (2, 90), (2, 92), (2, 95), (2, 100), (2, 101), (2, 103), (2, 116), (2, 122)})
XMP_NAMES = frozenset({
    "artist", "creator", "ownername", "creatortool", "software", "rights", "copyright", "copyrightnotice", "documentid", "instanceid",
    "originaldocumentid", "identifier", "imageuniqueid", "serialnumber", "cameraserialnumber", "lensserialnumber", "model", "datetimeoriginal",
    "datecreated", "createdate", "location", "sublocation", "city", "state", "provincestate", "country", "countryname", "countrycode",
    "locationcreated", "locationshown", "hasextendedxmp",
})
TOMBSTONE = 0xFFFF


def removal_reason(marker: int, payload: bytes) -> str | None:
    """Why full removal drops an APPn or COM segment; None where it stays (JFIF, ICC, Adobe)."""
    if marker == COM:
        return "JPEG comment metadata"
    n = marker - 0xE0
    kept = {0: (b"JFIF\0", b"JFXX\0"), 2: (ICC_ID,), 14: (b"Adobe",)}.get(n, ())
    if payload.startswith(kept) if kept else False:
        return None
    if n == 1:
        return "EXIF metadata" if payload.startswith(EXIF_ID) else "XMP metadata" if payload.startswith((XMP_ID, XMP_EXT_ID)) else "APP1 application metadata"
    return "APP2 non-ICC metadata" if n == 2 else f"APP{n} application metadata" if 0 <= n <= 15 else None


def full(data: bytes, limits: Limits = DEFAULT) -> Rewrite:
    def rule(marker: int, payload: bytes) -> tuple[bytes | None, str | None]:
        reason = removal_reason(marker, payload)
        return (payload, None) if reason is None else (None, reason)

    return full_walk(data, rule, strip_trailing=True, limits=limits)


def _pointer(block: Block, d: Directory, tag: int) -> tuple[Entry, int] | None:
    e = next((x for x in d.entries if x.tag == tag), None)
    if e is None:
        return None
    need(e.type == 4 and e.count == 1, f"pointer {tag:04X} is not one LONG")
    at = block.pointer(e)
    need(at > 0, f"pointer {tag:04X} is null")
    return e, at


def _zero(out: bytearray, block: Block, e: Entry) -> None:
    """Blank an entry's value, wherever it stands."""
    size = TYPES[e.type][1] * e.count if e.type in TYPES else 0
    if size > 4:
        at = block.pointer(e)
        need(at >= 8 and at + size <= len(out), "value lies outside the data")
        out[at : at + size] = bytes(size)


def _bury(out: bytearray, block: Block, e: Entry) -> None:
    """Leave an entry without tag or value in its place, so no offset moves."""
    _zero(out, block, e)
    out[e.at : e.at + 12] = struct.pack(block.order + "HHI", TOMBSTONE, 7, 4) + bytes(4)


def exif(payload: bytes, private: bool, limits: Limits = DEFAULT) -> bytes | None:
    """An EXIF payload without its GPS directory and, if ``private``, private tags; None if nothing goes."""
    data = payload[len(EXIF_ID) :]
    block = Block.open(data, limits)
    out, changed = bytearray(data), False
    ifd0 = block.directory(block.first)
    if (found := _pointer(block, ifd0, GPS_POINTER)) is not None:
        entry, at = found
        gps = block.directory(at, 1)
        for e in gps.entries:
            _zero(out, block, e)
        out[gps.offset : gps.end] = bytes(gps.end - gps.offset)
        _bury(out, block, entry)
        changed = True
    if private:
        sub = _pointer(block, ifd0, EXIF_POINTER)
        groups = [(ifd0, IFD0_TAGS)] + ([(block.directory(sub[1], 1), EXIF_TAGS)] if sub else [])
        for d, tags in groups:
            for e in d.entries:
                if e.tag in tags:
                    _bury(out, block, e)
                    changed = True
    return EXIF_ID + bytes(out) if changed else None


def selective(data: bytes, mode: str, limits: Limits = DEFAULT) -> Rewrite:
    """``gps``: locations go. ``privacy``: also owners, devices, software, dates, places, comments and what follows EOI."""
    need(mode in ("gps", "privacy"), f"unknown mode {mode}")
    private = mode == "privacy"

    def rule(marker: int, payload: bytes) -> tuple[bytes | None, str | None]:
        if marker == 0xE1 and payload.startswith(EXIF_ID):
            new = exif(payload, private, limits)
            return (payload, None) if new is None else (new, "EXIF fields redacted")
        if marker == 0xE1 and payload.startswith(XMP_EXT_ID):
            return None, "extended XMP removed"
        if marker == 0xE1 and payload.startswith(XMP_ID):
            new = xmp.sanitize(payload[len(XMP_ID) :], XMP_NAMES if private else frozenset(), limits)
            return (payload, None) if new is None else (XMP_ID + new, "XMP properties removed")
        if private and marker == 0xED and payload.startswith(PHOTOSHOP_ID):
            new = iptc.without(payload, IPTC_SETS, limits)
            return (payload, None) if new is None else (new or None, "IPTC datasets removed")
        if private and marker == COM:
            return None, "JPEG comment removed"
        return payload, None

    return full_walk(data, rule, strip_trailing=private, limits=limits)


def scrub(data: bytes, mode: str, limits: Limits = DEFAULT) -> Rewrite:
    return full(data, limits) if mode == "all" else selective(data, mode, limits)
