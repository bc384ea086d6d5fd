"""ICC profiles: chunks in APP2 segments, header, tags and name."""

from __future__ import annotations

import struct

from lumenlake.kernels.jpeg import ICC_ID
from lumenlake.kernels.limits import DEFAULT, Limits, need

#: Names of profile classes and colour spaces.
CLASSES = {"scnr": "Input device", "mntr": "Display device", "prtr": "Output device", "link": "Device link", "spac": "Color space conversion", "abst": "Abstract", "nmcl": "Named color"}
SPACES = (
    {"XYZ ": "CIE XYZ", "Lab ": "CIELAB", "Luv ": "CIELUV", "YCbr": "YCbCr", "Yxy ": "CIE Yxy", "RGB ": "RGB", "GRAY": "Gray", "HSV ": "HSV", "HLS ": "HLS", "CMYK": "CMYK", "CMY ": "CMY"}
    | {f"{n:X}CLR": f"{n} color" for n in range(2, 16)}
)


def chunk(payload: bytes) -> tuple[int, int, bytes]:
    """Sequence number, total and data of a segment's payload."""
    need(payload.startswith(ICC_ID) and len(payload) >= len(ICC_ID) + 2, "ICC chunk is short")
    seq, total = payload[len(ICC_ID)], payload[len(ICC_ID) + 1]
    need(seq != 0 and total != 0 and seq <= total, "ICC chunk numbering is invalid")
    return seq, total, payload[len(ICC_ID) + 2 :]


def reassemble(payloads: list[bytes], limits: Limits = DEFAULT) -> bytes | None:
    if not payloads:
        return None
    need(len(payloads) <= limits.max_icc_chunks, "too many ICC chunks")
    parts = [chunk(p) for p in payloads]
    totals = {t for _, t, _ in parts}
    need(len(totals) == 1, "ICC chunks disagree on their number")
    by = {s: d for s, _, d in parts}
    need(len(by) == len(parts), "duplicate ICC chunk")
    need(set(by) == set(range(1, totals.pop() + 1)), "ICC chunks are missing")
    data = b"".join(by[k] for k in sorted(by))
    need(len(data) <= limits.max_icc_profile_bytes, "ICC profile exceeds the limit")
    return data


def _signature(raw: bytes) -> str:
    return raw.decode("latin-1")


def _named(table: dict[str, str], raw: bytes) -> str:
    return table.get(_signature(raw)) or f"Unknown ({_signature(raw)})"


def parse(data: bytes, limits: Limits = DEFAULT) -> dict:
    need(len(data) >= 128, "ICC profile is short")
    (size,) = struct.unpack_from(">I", data)
    need(128 <= size <= len(data), "ICC profile's declared size is invalid")
    data = data[:size]
    need(data[36:40] == b"acsp", "ICC signature is missing")
    tags = []
    if size >= 132:
        (count,) = struct.unpack_from(">I", data, 128)
        need(count <= limits.max_icc_tags, "too many ICC tags")
        need(132 + 12 * count <= size, "ICC tag table exceeds the profile")
        for k in range(count):
            sig, at, length = struct.unpack_from(">4sII", data, 132 + 12 * k)
            need(at + length <= size, "ICC tag lies outside the profile")
            tags.append({"signature": _signature(sig), "offset": at, "size": length})
    desc = next((t for t in tags if t["signature"] == "desc"), None)
    return {
        "size": size, "cmm": _signature(data[4:8]), "version": f"{data[8]}.{data[9] >> 4}.{data[9] & 15}", "profile_class": _named(CLASSES, data[12:16]),
        "color_space": _named(SPACES, data[16:20]), "pcs": _named(SPACES, data[20:24]), "platform": _signature(data[40:44]), "tags": tags,
        "name": _name(data[desc["offset"] : desc["offset"] + desc["size"]]) if desc else None,
    }


def _name(raw: bytes) -> str | None:
    if raw[:4] == b"desc" and len(raw) >= 12:
        (n,) = struct.unpack_from(">I", raw, 8)
        need(12 + n <= len(raw), "ICC description is truncated")
        return raw[12 : 12 + n].split(b"\0", 1)[0].decode("latin-1").strip() or None
    if raw[:4] == b"mluc" and len(raw) >= 16:
        count, width = struct.unpack_from(">II", raw, 8)
        need(width >= 12 and 16 + count * width <= len(raw), "ICC name table is truncated")
        records = []
        for k in range(count):
            language, country, length, at = struct.unpack_from(">2s2sII", raw, 16 + k * width)
            need(at + length <= len(raw), "ICC name lies outside its tag")
            records.append((language, country, raw[at : at + length].decode("utf-16-be", "replace").rstrip("\0").strip()))
        # US English before other English before the first.
        records.sort(key=lambda r: (r[0] != b"en", r[1] != b"US") if r[0] == b"en" else (True, True))
        return (records[0][2] or None) if records else None
    return None
