"""Kernels over encoded fixtures: known values, byte orders, limits, and hostile bytes."""

import random
import struct
from fractions import Fraction

import plain_capture as capture
import plain_gps as gps
import pytest

from lumenlake.kernels import containers, forge, icc, iptc, jpeg, photo, scrub, tiff, xmp
from lumenlake.kernels.limits import Limits, ParseError

IFD0 = [(0x010E, 2, "Sample photo"), (0x010F, 2, "Samsung"), (0x0110, 2, "SM-S938B"), (0x0112, 3, 1), (0x011A, 5, (72, 1)), (0x0131, 2, "One UI Camera"), (0x0132, 2, "2026:08:11 14:32:51"), (0x8298, 2, "Test Copyright")]
EXIF = [
    (0x829A, 5, (1, 120)), (0x829D, 5, (17, 10)), (0x8827, 3, 100), (0x9003, 2, "2026:08:11 14:32:51"), (0x9204, 10, (-1, 3)), (0x920A, 5, (24, 1)),
    (0xA002, 4, 4096), (0xA003, 4, 3072), (0xA431, 2, "SN1"), (0xA433, 2, "nubia"), (0xA434, 2, "REDMAGIC Camera"),
]
GPS = [
    (1, 2, "N"), (2, 5, [(19, 1), (25, 1), (35868, 625)]), (3, 2, "W"), (4, 5, [(99, 1), (7, 1), (148881, 2500)]), (5, 1, 0), (6, 5, (2240, 1)),
    (7, 5, [(16, 1), (32, 1), (51, 1)]), (0x11, 5, (12345, 100)), (0x1D, 2, "2026:08:11"),
]


def sample(big=False, trailing=b"zz"):
    parts = [
        forge.exif(IFD0, EXIF, GPS, big_endian=big),
        forge.xmp({"xmp:CreatorTool": "T", "xmp:Rating": "5"}, {"dc:creator": ["Test Creator", "Second Creator"]}, {"es": "otro", "x-default": "Puerto de Veracruz"}),
        forge.iptc([(1, 90, b"\x1b%G"), (2, 25, b"Veracruz"), (2, 25, "fortaleza histórica".encode()), (2, 90, b"Veracruz")], [(0x0425, b"abc")]),
        *forge.icc(forge.icc_profile("Test RGB Profile", localized=big), 2),
        forge.segment(0xFE, b"hello"),
    ]
    return forge.jpeg(parts, 32, 16, trailing=trailing)


@pytest.mark.parametrize("big", [False, True])
def test_all_facts_in_one_pass(big):
    r = photo.parse(sample(big))
    assert r["errors"] == [] and (r["width"], r["height"], r["jpeg_process"]) == (32, 16, "Baseline DCT")
    assert [p["qualified_name"] for p in r["xmp"]] == ["xmp:CreatorTool", "xmp:Rating", "dc:creator", "dc:title"]
    assert r["xmp"][2]["value_list"] == ["Test Creator", "Second Creator"] and r["xmp"][3]["value_text"] == "Puerto de Veracruz"
    assert [d["text"] for d in r["iptc"]] == [None, "Veracruz", "fortaleza histórica", "Veracruz"]
    assert (r["icc"]["name"], r["icc"]["profile_class"], r["icc"]["color_space"], r["icc"]["version"]) == ("Test RGB Profile", "Display device", "RGB", "4.3.0")
    assert r["structural"] == [] and r["trailing_bytes"] == 2


def test_byte_orders_agree():
    strip = lambda r: [{k: v for k, v in t.items()} for t in r["tags"] if t["tag"] not in (0x8769, 0x8825)]
    assert strip(photo.parse(sample(False))) == strip(photo.parse(sample(True)))


@pytest.mark.parametrize("mode", ["all", "gps", "privacy"])
@pytest.mark.parametrize("big", [False, True])
def test_scrubbing_keeps_the_image(mode, big):
    data = sample(big)
    done = scrub.scrub(data, mode)
    after = photo.parse(done.data)
    assert after["errors"] == [] and after["scan_sha256"] == photo.parse(data)["scan_sha256"] and (after["width"], after["height"]) == (32, 16)
    assert after["presence"]["gps"] == "NO" and not any(t["ifd"] == "GPS" for t in after["tags"])
    assert scrub.scrub(done.data, mode).changes == []
    assert after["icc"]["name"] == "Test RGB Profile"
    assert after["trailing_bytes"] == (2 if mode == "gps" else 0)
    names = [d["name"] for d in after["iptc"]]
    assert names == {"all": [], "gps": ["CodedCharacterSet", "Keywords", "Keywords", "City"], "privacy": ["CodedCharacterSet", "Keywords", "Keywords"]}[mode]
    if mode == "privacy":
        assert {"Model", "Software", "Copyright", "BodySerialNumber", "DateTimeOriginal"}.isdisjoint(t["tag_name"] for t in after["tags"])
        assert {f["code"] for f in after["structural"]} == {"duplicate_tag"}  # tombstones repeat


def test_late_metadata_between_scans_goes():
    sos = forge.segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    data = b"\xff\xd8" + forge.segment(0xC0, b"\x08\x00\x10\x00\x20\x01\x01\x11\x00") + sos + b"\x11\x22" + forge.segment(0xE1, b"Exif\0\0late-metadata") + sos + b"\x33\x44\xff\xd9"
    done = scrub.full(data)
    assert b"late" not in done.data and done.scan_sha256 == jpeg.full_walk(data).scan_sha256


def test_restart_stuffing_and_fill():
    sos = forge.segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    frame = forge.segment(0xC2, b"\x08\x00\x10\x00\x20\x01\x01\x11\x00")
    walk = jpeg.full_walk(b"\xff\xd8" + frame + sos + b"\x11\xff\x00\x22\xff\xd0\x33\xff\xff\xd9")
    assert walk.scan_bytes == 7 and walk.trailing == b""


@pytest.mark.parametrize(
    "data,limits,message",
    [
        (b"\xff\xd8broken", Limits(), "marker expected"),
        (b"\xff\xd8" + b"\xff\xe1\x00\x02" * 5000, Limits(), "too many JPEG segments"),
        (b"\xff\xd8" + b"\xff" * 2000 + b"\xe0\x00\x02", Limits(), "fill"),
        (b"\xff\xd8\xff\xe1\x00\x10ab", Limits(), "short"),
        (sample(), Limits(max_jpeg_header_payload_bytes=100), "exceed"),
        (sample(), Limits(max_input_file_bytes=10), "exceeds"),
    ],
)
def test_header_limits(data, limits, message):
    with pytest.raises(ParseError, match=message):
        jpeg.header_walk(data, limits)


def test_tiff_limits_and_cycles():
    with pytest.raises(ParseError):
        tiff.Block.open(b"II*\0")
    block = tiff.Block.open(forge.tiff(IFD0))
    block.directory(8)
    with pytest.raises(ParseError, match="circular"):
        block.directory(8)
    with pytest.raises(ParseError, match="too many directory entries"):
        tiff.Block.open(forge.tiff(IFD0), Limits(max_ifd_entries=2)).directory(8)
    zero = tiff.Block.open(forge.tiff([(0x011A, 5, (1, 0))]))
    with pytest.raises(ParseError, match="zero denominator"):
        zero.decode(zero.directory(8), "IFD0")


def test_value_types():
    fields = [(1, 1, 200), (2, 6, -5), (3, 8, -300), (4, 9, -70000), (5, 4, 2**32 - 1), (6, 5, (2, 4)), (7, 10, (-3, 9)), (8, 11, 0.5), (9, 12, 0.1), (10, 3, [1, 2, 3]), (11, 7, b"\0\1\2\3\4"), (12, 2, "hi")]
    for big in (False, True):
        block = tiff.Block.open(forge.tiff(fields, big_endian=big))
        values = [r["value"] for r in block.decode(block.directory(8), "IFD0")]
        assert values == [200, -5, -300, -70000, 2**32 - 1, Fraction(1, 2), Fraction(-1, 3), 0.5, 0.1, (1, 2, 3), b"\0\1\2\3\4", "hi"]
    assert tiff.tagged(())["is_scalar"] is False and tiff.tagged(0)["ints"] == [0]


def test_structural_findings():
    codes = lambda data: [f["code"] for f in photo.structure(data)]
    assert codes(forge.tiff([(0x0110, 2, "A"), (0x0110, 2, "B")])) == ["duplicate_tag"]
    raw = struct.pack("<2sHIHHHI4sI", b"II", 42, 8, 1, 0x0110, 2, 10, struct.pack("<I", 4), 0)
    assert codes(raw) == ["suspicious_offset"]
    assert codes(raw.replace(struct.pack("<I", 4), struct.pack("<I", 5000))) == ["suspicious_offset"]
    assert codes(struct.pack("<2sHIHHHI4sI", b"II", 42, 8, 1, 0x0110, 99, 1, b"abcd", 0)) == ["invalid_tiff_type"]
    assert codes(struct.pack("<2sHIHHHI4sI", b"II", 42, 8, 1, 0x8769, 4, 1, struct.pack("<I", 9000), 0)) == ["suspicious_offset"]
    assert codes(struct.pack("<2sHIHHHI4sI", b"II", 42, 8, 1, 0x8769, 4, 1, struct.pack("<I", 10), 0)) == ["suspicious_offset"]
    assert codes(forge.tiff([(0x8769, 3, [1, 2])])) == ["invalid_ifd_pointer"]


def test_xmp_refuses_entities_and_keeps_budgets():
    for bad in (b"", b"<!DOCTYPE x><x/>", b"<x>&e;</x>", b"<x"):
        with pytest.raises(ParseError):
            xmp.properties(bad)
    packet = forge.xmp_packet({"xmp:CreatorTool": "x"})
    assert len(xmp.properties(packet + b"\0\0")) == 1
    with pytest.raises(ParseError, match="too many nodes"):
        xmp.properties(packet, Limits(max_xmp_xml_nodes=2))
    assert xmp.sanitize(packet, frozenset()) is None
    assert b"GPS" not in xmp.sanitize(forge.xmp_packet({"exif:GPSLatitude": "1", "xmp:Rating": "1"}), frozenset())


def test_iptc_extended_length_and_limits():
    data = struct.pack(">BBBH", 0x1C, 2, 120, 0x8004) + struct.pack(">I", 3) + b"abc"
    assert iptc.datasets(data)[0][:3] == (2, 120, b"abc")
    with pytest.raises(ParseError):
        iptc.datasets(struct.pack(">BBBH", 0x1C, 2, 120, 0x8009) + bytes(9))
    with pytest.raises(ParseError):
        iptc.datasets(b"\x1c\x02\x05\x00\x09ab")


def test_icc_chunks():
    parts = [s[4:] for s in forge.icc(forge.icc_profile("P"), 3)]
    assert icc.parse(icc.reassemble(parts[::-1]))["name"] == "P"
    for bad in (parts[:2], [parts[0], parts[0], parts[1]]):
        with pytest.raises(ParseError):
            icc.reassemble(bad)


def test_texts():
    assert gps.time_text((16, 32, Fraction(21, 4))) == "16:32:05.25 UTC" and gps.time_text((25, 0, 0)) is None
    assert gps.date_text("2026:8:11") == "2026:8:11"
    assert gps.altitude(Fraction(5), 1) == (-5.0, 1, "negative ellipsoidal height") and gps.altitude(Fraction(5), None)[2] == "reference not provided"
    assert capture.exposure(Fraction(5, 2)) == "2.5 s" and capture.exposure(0) is None and capture.aperture(1.7) is None
    assert capture.lens("Canon", "canon EF") == "canon EF" and capture.date_time("bad") == ("bad", None)
    with pytest.raises(ParseError):
        gps.decimal((Fraction(1), 60, 0), "N")


def test_containers():
    assert containers.heif(forge.ftyp(b"mif1", [b"heic"]))["heif_format"] == "HEIC" and containers.heif(forge.ftyp(b"mif1", [b"avif"]))["heif_format"] is None
    with pytest.raises(ParseError):
        containers.inspect(b"GIF89a")


def test_bytes_at_random_never_raise():
    rnd, good = random.Random(5), sample(True)
    for _ in range(1500):
        b = bytearray(good)
        for _ in range(rnd.randrange(1, 6)):
            b[rnd.randrange(len(b))] = rnd.randrange(256)
        photo.parse(bytes(b[: rnd.randrange(len(b))] if rnd.random() < 0.3 else b))


def deep_packet(n):
    rdf = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    head = f'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="{rdf}"><rdf:Description xmlns:exif="http://ns.adobe.com/exif/1.0/" exif:GPSLatitude="1">'
    return (head + "<a>" * n + "x" + "</a>" * n + "</rdf:Description></rdf:RDF></x:xmpmeta>").encode()


def test_deep_packets_are_cleaned():
    out = xmp.sanitize(deep_packet(9000), frozenset())
    assert b"GPS" not in out and out.count(b"<a>") == 9000 and sum(1 for _ in xmp.tree(out).iter("a")) == 9000


def test_serialised_packets_read_back():
    import xml.etree.ElementTree as ET

    packet = b'<a xmlns:q="urn:q" xml:lang="x">t&amp;&lt;<q:b c="&quot;&#10;&#9;\xc3\xa9" q:d="1"/>u<e>v</e>w]]&gt;</a>'
    root, again = ET.fromstring(packet), ET.fromstring(xmp.serialise(ET.fromstring(packet)))
    flat = lambda e: [(x.tag, x.attrib, x.text, x.tail) for x in e.iter()]
    assert flat(root) == flat(again)


def test_parts_agree_with_the_whole():
    data, whole = sample(), photo.parse(sample())
    for columns in (("segments",), ("width", "height"), ("tags",), ("has", "xmp", "errors"), ("iptc",), ("icc",), ("presence", "scan_sha256"), ("structural", "exif_segments")):
        part = photo.parse(data, wanted=frozenset(columns))
        assert all(part[c] == whole[c] for c in columns)
    assert photo.parse(data, wanted=frozenset({"width"}))["tags"] == []


def test_values_without_numbers():
    """What tells of a value, or makes it a row, without fractions says the same as the value itself, also where it cannot be decoded."""
    import random

    from lumenlake.kernels.limits import ParseError
    from lumenlake.kernels.tiff import TYPES, Block, Entry, has_value, tagged, union_filled

    draw = random.Random(3)

    def of(f):
        try:
            return f()
        except ParseError as e:
            return str(e)

    for k in range(3000):
        order, kind, n = draw.choice("<>"), draw.choice([*TYPES, 99]), draw.choice([0, 1, 2, 3])
        data = bytes(draw.choice((0, 0, 1, 32, 65, 200)) for _ in range(64))
        size = TYPES.get(kind, ("", 1))[1] * n
        raw = data[:4] if size <= 4 else draw.choice((8, 16, 60)).to_bytes(4, "little" if order == "<" else "big")
        block, e = Block(data, order, 8), Entry(0x0110, kind, n, raw, 0)
        assert of(lambda: block.filled(e)) == of(lambda: has_value(block.value(e)))
        assert of(lambda: block.union(e)) == of(lambda: tagged(block.value(e)))
        assert of(lambda: union_filled(block.union(e))) == of(lambda: has_value(block.value(e)))
