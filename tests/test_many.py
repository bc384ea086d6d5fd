"""Photos read many at a time, and EXIF segments made by shape, against one at a time."""

from __future__ import annotations

import random
from datetime import date, timedelta

from lumenlake.kernels import forge
from lumenlake.kernels.limits import Limits
from lumenlake.kernels.many import COLUMNS, parse_many
from lumenlake.kernels.photo import parse
from lumenlake.operators import comparison, privacy
from lumenlake.plans import cases, forged

ROWS = [{"o": o, "c": o * 7 % 1501, "d": date(1992, 1, 1) + timedelta(days=o % 2000)} for o in range(900)]


def _hurt(blob: bytes, draw: random.Random) -> bytes:
    out = bytearray(blob)
    for _ in range(draw.randint(1, 3)):
        out[draw.randrange(2, len(out))] = draw.choice([0, 1, 5, 255, draw.randrange(256)])
    return bytes(out[: draw.randrange(len(out))] if draw.random() < 0.1 else out)


def test_many_at_a_time_find_what_one_at_a_time_finds():
    draw, makers = random.Random(3), (cases.anomaly_photo, cases.private_photo, cases.first_side, cases.place_photo, cases.plain_photo, cases.packet_photo, cases.chunk_photo)
    whole = [make(r) for r in ROWS for make in (forged.order_photo, forged.blocks_photo)] + [make({"k": k}) for make in makers for k in range(30)] + [b"", b"\xff\xd8"]
    blobs = whole + [_hurt(draw.choice(whole[:-2]), draw) for _ in range(3000)]
    some = frozenset({"GPS/GPSLatitude", "ExifIFD/ExposureTime"})
    for wanted, only, values in (
        (frozenset(privacy.NEEDS), None, True), (frozenset({*privacy.NEEDS, *comparison.NEEDS}), None, True), (frozenset({"tags"}), None, True), (frozenset({"tags"}), some, True),
        (frozenset({"tags", "errors"}), None, False), (COLUMNS, None, True), (COLUMNS, some, True),
    ):
        found = [x for at in range(0, len(blobs), 700) for x in parse_many(blobs[at : at + 700], wanted, only=only, values=values)]
        for blob, many in zip(blobs, found, strict=True):
            if many is not None:
                one = parse(blob, wanted=wanted, only=only, values=values)
                assert {k: many.get(k) for k in wanted} == {k: one[k] for k in wanted}
        # Only what is cut off or odd is left to the other way.
        assert sum(x is None for x in found[: 2 * len(ROWS) : 2]) == sum(r["o"] % 101 == 0 for r in ROWS)


def test_many_at_a_time_keeps_budgets():
    assert parse_many([forged.order_photo(ROWS[1])], frozenset({"width"}), Limits(max_jpeg_segments=2)) == [None]


def test_only_some_tags_and_all_must_be_sound():
    photo = forged.order_photo(ROWS[8])
    tags, some = parse(photo)["tags"], frozenset({"IFD0/Model", "GPS/GPSLatitude"})
    assert parse(photo, wanted=frozenset({"tags"}), only=some)["tags"] == [t for t in tags if f"{t['ifd']}/{t['tag_name']}" in some]
    assert parse(photo, wanted=frozenset({"tags"}), values=False)["tags"] == [t | {"value": None} for t in tags]
    broken = forge.jpeg([forge.exif([(0x010F, 2, "Make")], [(0x829A, 5, (1, 0))])], 8, 8)
    for wanted in ({"tags"}, {"has"}):
        facts = parse(broken, wanted=frozenset(wanted), only=some)
        assert facts["errors"] == [{"part": "exif", "message": "rational with a zero denominator"}] and facts["tags"] == [] == facts["has"]


def test_segments_made_by_shape():
    fields = [(0x010F, 2, "Make1"), (0x0110, 2, "M1"), (0x0112, 3, 5)], [(0x829A, 5, (1, 9)), (0x9204, 10, (-3, 7)), (0xA002, 4, 77)], [(1, 2, "N"), (2, 5, [(1, 2), (3, 4), (5, 6)]), (5, 1, 1)]
    shapes = [((0x010F, 2, 6), (0x0110, 2, 3), (0x0112, 3, 1)), ((0x829A, 5, 1), (0x9204, 10, 1), (0xA002, 4, 1)), ((1, 2, 2), (2, 5, 3), (5, 1, 1))]
    values = [[b"Make1", b"M1", 5], [1, 9, -3, 7, 77], [b"N", 1, 2, 3, 4, 5, 6, 1]]
    for big in (False, True):
        for n in (1, 2, 3):
            assert forge.exif_of(big, *shapes[:n])(sum(values[:n], [])) == forge.exif(*fields[:n], big_endian=big)
