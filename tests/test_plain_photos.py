"""Sound photos are read many at a time for every column of the bronze table."""

from __future__ import annotations

from datetime import date

from lumenlake.kernels import forge
from lumenlake.kernels.many import parse_many
from lumenlake.kernels.photo import parse
from lumenlake.operators import anomalies
from lumenlake.plans import forged

PHOTOS = [forged.order_photo({"o": o, "c": o * 7 % 1501, "d": date(1995, 1, 1)}) for o in range(1, 101)]


def test_every_column_of_a_plain_photo_comes_at_once():
    every = frozenset(parse(PHOTOS[0]))
    for wanted in (every, frozenset(anomalies.NEEDS)):
        found = parse_many(PHOTOS, wanted)
        assert None not in found
        for blob, many in zip(PHOTOS, found, strict=True):
            assert {k: many[k] for k in wanted} == {k: v for k, v in parse(blob).items() if k in wanted}


def test_values_over_a_directory_are_left_to_the_careful_way():
    """A text that lies over its own directory, and a pointer into it, are findings: such files are not plain."""
    photo = bytearray(forge.jpeg([forge.exif([(0x010F, 2, "Maker"), (0x0110, 2, "Model 1")], [(0x829A, 5, (1, 9))])], 8, 8))
    block = photo.index(b"II*\0")
    entries = block + 8 + 2
    for k, code in ((0, "suspicious_offset"), (2, "suspicious_offset")):  # Make's text; the pointer to the second directory
        odd = bytearray(photo)
        odd[entries + 12 * k + 8 : entries + 12 * k + 12] = (10).to_bytes(4, "little")
        assert code in [f["code"] for f in parse(bytes(odd))["structural"]]
        assert parse_many([bytes(odd)], frozenset(anomalies.NEEDS)) == [None]


def test_rules_read_no_tags_beyond_those_named(spark, sf_dir):
    from lumenlake import queries

    some, whole = (anomalies.detect(queries.photos(spark, sf_dir, *anomalies.NEEDS, tags=tags)).select("o", "anomalies").collect() for tags in (anomalies.TAGS, None))
    assert sorted(some, key=str) == sorted(whole, key=str)
