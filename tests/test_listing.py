"""Files of any length are listed by their first bytes."""

from __future__ import annotations

from lumenlake.kernels import forge
from lumenlake.operators import batch
from lumenlake.plans.forged import part_file
from lumenlake.sources import files


def test_listed_as_by_whole_files(spark, tmp_path):
    for k in range(16):
        name, data = part_file({"p": k, "size": k})
        (tmp_path / name.rsplit("/", 1)[1]).write_bytes(data + bytes(k * 1000))
    (tmp_path / "é%20 #.jpg").write_bytes(b"\xff")
    (tmp_path / "brands.heic").write_bytes(forge.ftyp(b"none", [b"none"] * 1019 + [b"heic"]) + bytes(9))
    found = files.scan_directory(spark, str(tmp_path))
    whole = sorted(map(tuple, batch.items(found).select("path", "format", "size_bytes").collect()))
    assert sorted(map(tuple, batch.listed(found).collect())) == whole and len(whole) == 18


def test_a_file_longer_than_a_value_is_listed(spark, tmp_path):
    """Its first bytes tell its format; whole it would not fit in a value of a row."""
    from lumenlake.kernels.limits import Limits

    with open(tmp_path / "a.jpg", "wb") as out:
        out.write(b"\xff\xd8\xff")
        out.truncate(3 << 30)  # takes no room on disk
    found = files.scan_directory(spark, str(tmp_path))
    row = lambda limits: [tuple(r) for r in batch.listed(found, limits).select("format", "size_bytes").collect()]
    assert row(Limits(max_input_file_bytes=4 << 30)) == [("JPEG", 3 << 30)] and row(Limits()) == [("UNSUPPORTED", 3 << 30)]
