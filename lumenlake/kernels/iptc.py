"""Photoshop image resources and the IPTC datasets among them."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import lru_cache

from lumenlake.kernels.jpeg import PHOTOSHOP_ID
from lumenlake.kernels.limits import DEFAULT, Limits, need
from lumenlake.kernels.names import IPTC

RESOURCE = 0x0404


@dataclass(frozen=True)
class Resource:
    id: int
    data: bytes
    start: int  # of the whole resource in the block
    end: int


def resources(block: bytes, limits: Limits = DEFAULT) -> list[Resource]:
    need(block.startswith(PHOTOSHOP_ID), "not a Photoshop block")
    need(len(block) <= limits.max_photoshop_payload_bytes, "Photoshop block exceeds the limit")
    out, at = [], len(PHOTOSHOP_ID)
    while at < len(block):
        if not block[at:].strip(b"\0"):
            break
        start = at
        need(block[at : at + 4] == b"8BIM", f"resource signature expected at {at}")
        need(len(out) < limits.max_photoshop_resources, "too many Photoshop resources")
        need(at + 7 <= len(block), "Photoshop resource is truncated")
        rid, name = struct.unpack_from(">HB", block, at + 4)
        at += 6 + (name + 2) // 2 * 2
        need(at + 4 <= len(block), "Photoshop resource is truncated")
        (size,) = struct.unpack_from(">I", block, at)
        at += 4
        need(size <= limits.max_photoshop_resource_bytes, "Photoshop resource exceeds the limit")
        need(at + size <= len(block), "Photoshop resource is truncated")
        data = block[at : at + size]
        at = min(len(block), at + size + size % 2)
        out.append(Resource(rid, data, start, at))
    return out


def datasets(data: bytes, limits: Limits = DEFAULT) -> list[tuple[int, int, bytes, bytes]]:
    """(record, number, value, whole dataset) in order."""
    need(len(data) <= limits.max_iptc_data_bytes, "IPTC data exceeds the limit")
    out, at = [], 0
    while at < len(data):
        if not data[at:].strip(b"\0"):
            break
        start = at
        need(data[at] == 0x1C, f"dataset marker expected at {at}")
        need(at + 5 <= len(data), "dataset header is truncated")
        need(len(out) < limits.max_iptc_datasets, "too many IPTC datasets")
        record, number, length = struct.unpack_from(">BBH", data, at + 1)
        at += 5
        if length & 0x8000:
            octets = length & 0x7FFF
            need(0 < octets <= limits.max_iptc_length_octets, "extended length has too many octets")
            need(at + octets <= len(data), "extended length is truncated")
            length = int.from_bytes(data[at : at + octets], "big")
            at += octets
        need(length <= limits.max_iptc_value_bytes, "IPTC value exceeds the limit")
        need(at + length <= len(data), "IPTC value is truncated")
        out.append((record, number, data[at : at + length], data[start : at + length]))
        at += length
    return out


def rows(block: bytes, limits: Limits = DEFAULT) -> list[dict] | None:
    """Datasets of the first IPTC resource of a block; None where it has none."""
    found = next((r for r in resources(block, limits) if r.id == RESOURCE), None)
    if found is None:
        return None
    parsed = datasets(found.data, limits)
    utf8 = any(r == 1 and n == 90 and v == b"\x1b%G" for r, n, v, _ in parsed)
    out = []
    for k, (record, number, value, _) in enumerate(parsed):
        name = IPTC.get((record, number))
        text = None if name is None or (record, number) == (1, 90) else value.decode("utf-8" if utf8 else "latin-1", "replace")
        out.append({"pos": k, "record": record, "dataset": number, "name": name or f"Unknown_{record}_{number}", "text": text, "raw": value, "encoding": "utf-8" if utf8 else "latin-1"})
    return out


def filled(found: list[dict]) -> list[str]:
    """Names, with their group, of the datasets that have a value."""
    return list(dict.fromkeys(f"IPTC/{r['name']}" for r in found if r["text"] is not None and r["text"].strip()))


@lru_cache(1024)
def names_filled(block: bytes, limits: Limits = DEFAULT) -> tuple[str, ...] | None:
    """``filled`` of a block's datasets, None where it has none; many files have the same block."""
    found = rows(block, limits)
    return None if found is None else tuple(filled(found))


def without(block: bytes, private: frozenset[tuple[int, int]], limits: Limits = DEFAULT) -> bytes | None:
    """The block without private datasets, other resources byte for byte; empty bytes if nothing is left, None if nothing goes."""
    out, removed = [PHOTOSHOP_ID], 0
    for r in resources(block, limits):
        if r.id != RESOURCE:
            out.append(block[r.start : r.end])
            continue
        parsed = datasets(r.data, limits)
        left = [whole for record, number, _, whole in parsed if (record, number) not in private]
        if len(left) == len(parsed):
            out.append(block[r.start : r.end])
            continue
        removed += len(parsed) - len(left)
        if any(not whole.startswith(b"\x1c\x01") for whole in left):
            data = b"".join(left)
            head = block[r.start : r.start + 6 + (block[r.start + 6] + 2) // 2 * 2]
            out.append(head + struct.pack(">I", len(data)) + data + b"\0" * (len(data) % 2))
    if not removed:
        return None
    return b"".join(out) if len(out) > 1 else b""
