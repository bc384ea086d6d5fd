"""Blobs that show one thing each, by a row's key: anomalies, private fields, changes between two files, odd values, scrubbed bytes.

The number of a case is the key modulo the number of cases; ``case_queries`` restates what each case must give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.plans.forged import forged

ANOMALIES, PRIVATE, CHANGES, PLACES, BUDGETS, PACKETS, CHUNKS = 24, 12, 21, 12, 24, 6, 9
MADE = [(0x010F, 2, "Make"), (0x0110, 2, "Model")]
LATITUDE, LONGITUDE = [(1, 2, "N"), (2, 5, [(19, 1), (25, 1), (30, 1)])], [(3, 2, "W"), (4, 5, [(99, 1), (7, 1), (48, 1)])]
DATED = [(0x1D, 2, "2026:08:11")]


def _raw_entry(tag: int, kind: int, count: int, value: bytes) -> bytes:
    """A TIFF block of one entry, which need not be sound."""
    import struct

    return struct.pack("<2sHIHHHI4sI", b"II", 42, 8, 1, tag, kind, count, value, 0)


def anomaly_photo(row: dict) -> bytes:
    """Case 0 is sound; each other one has one fault."""
    from lumenlake.kernels import forge as f
    from lumenlake.kernels.jpeg import EXIF_ID

    k = row["k"] % ANOMALIES
    whole = lambda *args: [f.exif(*args)]
    bare = lambda block: [f.segment(0xE1, EXIF_ID + block)]
    dates = lambda changed, original: whole([*MADE, (0x0132, 2, changed)], [(0x9003, 2, original)])
    wide, high = (0xA002, 0xA003), (0x0100, 0x0101)
    parts = {
        0: lambda: whole(MADE), 1: lambda: whole([*MADE, (0x0132, 2, "yesterday")]), 2: lambda: whole(MADE, [(0x9003, 2, "2020-01-02")]),
        3: lambda: dates("2020:01:01 00:00:00", "2020:01:02 00:00:00"), 4: lambda: dates("2020:01:03 00:00:00", "2020:01:02 00:00:00"),
        5: lambda: whole(MADE, None, LATITUDE), 6: lambda: whole(MADE, None, LATITUDE + LONGITUDE), 7: lambda: whole(MADE, None, LATITUDE[1:] + LONGITUDE + DATED),
        8: lambda: whole(MADE, [(wide[0], 4, 32)]), 9: lambda: whole(MADE, [(wide[0], 2, "wide"), (wide[1], 4, 16)]), 10: lambda: whole(MADE, [(wide[0], 4, 33), (wide[1], 4, 16)]),
        11: lambda: whole([(high[1], 4, 16), *MADE]), 12: lambda: whole([(high[0], 4, 32), (high[1], 5, (1, 2)), *MADE]), 13: lambda: whole([(high[0], 4, 32), (high[1], 4, 17), *MADE]),
        14: lambda: whole([*MADE, (0x0131, 2, "GIMP 2.10")]), 15: lambda: whole(MADE[:1]), 16: lambda: whole(MADE) + whole(MADE), 17: lambda: whole([*MADE, MADE[1]]),
        18: lambda: whole([*MADE, (0x8825, 4, 99999)]), 19: lambda: whole([*MADE, (0x8769, 3, [1, 2])]), 20: lambda: bare(_raw_entry(0x0110, 99, 1, b"abcd")),
        21: lambda: bare(_raw_entry(0x0110, 2, 4, b"\xff\xfe\xfd\0")), 22: lambda: bare(b"XX"), 23: lambda: whole(MADE),
    }[k]()
    data = f.jpeg(parts, 32, 16)
    return data[:-2] if k == 23 else data


def private_photo(row: dict) -> bytes:
    """Fields of one privacy rule from all the sources that it reads; case 10 has blanks only, case 11 nothing."""
    from lumenlake.kernels import forge as f

    k = row["k"] % PRIVATE
    exif = {
        0: ([], None, LATITUDE + LONGITUDE + [(5, 1, 0), (6, 5, (9, 1))]), 1: ([], None, LATITUDE), 2: ([], [(0xA431, 2, "B1"), (0xA435, 2, "L1")], None),
        3: ([], [(0x9003, 2, "2020:01:02 03:04:05")], None), 4: ([(0x0110, 2, "M")], None, None), 5: ([(0x013B, 2, "A")], [(0xA430, 2, "O")], None),
        6: ([(0x0131, 2, "S")], None, None), 7: ([(0x8298, 2, "C")], None, None), 8: ([], [(0xA420, 2, "U1")], None), 9: ([], None, None),
        10: ([(0x010F, 2, " "), (0x0110, 2, "  "), (0x013B, 2, "")], None, None), 11: ([], None, None),
    }[k]
    attributes, lists = {
        2: ({"xmp:SerialNumber": "X1"}, None), 5: ({"xmp:OwnerName": "P"}, {"dc:creator": ["Q"]}), 6: ({"xmp:CreatorTool": "T"}, None), 7: ({"dc:rights": "R"}, None),
        8: ({"xmp:DocumentID": "D", "xmp:InstanceID": "I"}, None), 9: ({"photoshop:City": "V"}, None), 10: ({"xmp:CreatorTool": " "}, None),
    }.get(k, (None, None))
    sets = {5: [(2, 80, b"By")], 7: [(2, 116, b"Cp")], 9: [(2, 90, b"Ci"), (2, 101, b"Co")], 10: [(2, 90, b"")]}.get(k)
    parts = [f.exif(*exif)] if any(x for x in exif) else []
    return f.jpeg(parts + ([f.xmp(attributes, lists)] if attributes else []) + ([f.iptc(sets)] if sets else []), 32, 16)


def _side(row: dict, copy: bool) -> bytes:
    from lumenlake.kernels import forge as f

    k = row["k"] % CHANGES
    #: Of each change by removal and addition: what stands on one side only.
    extra = {"exif": f.exif([(0x0112, 3, 1)]), "gps": f.exif([(0x0112, 3, 1)], None, LATITUDE), "xmp": f.xmp({"xmp:Rating": "1"}), "iptc": f.iptc([(2, 25, b"k")]), "model": f.exif([(0x0110, 2, "M1")])}
    kinds = ("exif", "gps", "xmp", "iptc", "icc", "model")
    parts = []
    if 1 <= k <= 12:
        kind, on = kinds[(k - 1) // 2], ((k - 1) % 2 == 0) != copy
        base = {"gps": [extra["exif"]], "model": [f.exif([(0x0112, 3, 1)])]}.get(kind, [])
        parts = (f.icc(f.icc_profile("P")) if kind == "icc" else [extra[kind]]) if on else base
    elif k == 13:
        parts = [f.exif([(0x0110, 2, "M2" if copy else "M1")])]
    tables = [f.segment(0xC4, b"\0" + bytes(16))] if k in (17, 19) and copy else [f.segment(0xC4, b"\1" + bytes(16))] if k in (17, 19) else []
    other = copy and k in (18, 19, 20)
    return f.jpeg(parts + tables, 33 if copy and k == 14 else 32, 16, b"other" if other else b"scan", 9 if copy and k in (16, 20) else 5, 0xC2 if copy and k == 15 else 0xC0)


def first_side(row: dict) -> bytes:
    return _side(row, False)


def second_side(row: dict) -> bytes:
    return _side(row, True)


def place_photo(row: dict) -> bytes:
    """Times, dates, altitudes, directions and lenses in their odd forms."""
    from lumenlake.kernels import forge as f

    k, n = row["k"] % PLACES, row["k"]
    time = {1: [(n % 24, 1), (n % 60, 1), (n % 60, 1)], 2: [(n % 24, 1), (n % 60, 1), (123, 4)], 3: [(24, 1), (0, 1), (0, 1)], 4: [(1, 1), (2, 1), (119, 2)]}.get(k)
    high = {5: [(6, 5, (n % 900, 2))], 6: [(5, 1, 1), (6, 5, (n % 900, 1))], 7: [(5, 1, 9), (6, 5, (5, 1))], 8: [(0x11, 5, (n % 36000, 100))], 9: [(0x1D, 2, "2026:8:1")]}.get(k, [])
    gps = LATITUDE + LONGITUDE + sorted(high + ([(7, 5, time)] if time else []))
    lens = {0: [(0xA433, 2, "Canon"), (0xA434, 2, "canon EF")], 1: [(0xA433, 2, "Nubia"), (0xA434, 2, "Wide")], 2: [(0xA434, 2, " Wide ")], 3: [(0xA433, 2, "Nubia")]}.get(k % 5, [])
    return f.jpeg([f.exif([(0x0112, 3, 1)], lens, gps)], 8, 8)


def plain_photo(row: dict) -> bytes:
    """JFIF, EXIF, a comment, an ICC profile of one chunk and a tail round a scan: what full removal leaves can be written down."""
    from lumenlake.kernels import forge as f

    k = row["k"]
    parts = [f.segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), f.exif([(0x0110, 2, f"M{k}")]), f.segment(0xFE, b"note"), f.segment(0xE1 + k % 12 + 1, b"own data"), f.segment(0xE2, b"ICC_PROFILE\0\1\1profile")]
    return f.jpeg(parts, 1 + k % 5000, 1 + k % 300, f"scan {k}".encode(), 1 + k % 60, trailing=b"tail" * (k % 3))


def files(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    """k, path, length and content of a file per customer."""
    table = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"))
    return forged(table, ["k"], make)


#: Of each case the budget that it lowers and to what; case 0 lowers none.
LOWERED = [
    ("max_input_file_bytes", 1024 << 20), ("max_input_file_bytes", 99), ("max_jpeg_segments", 3), ("max_jpeg_marker_fill_bytes", 1), ("max_jpeg_segment_payload_bytes", 40),
    ("max_jpeg_header_payload_bytes", 99), ("max_ifd_entries", 1), ("max_tiff_components", 1), ("max_tiff_value_bytes", 1), ("max_ifd_depth", 0), ("max_ifd_nodes", 1),
    ("max_xmp_packet_bytes", 99), ("max_xmp_xml_nodes", 2), ("max_xmp_properties", 1), ("max_icc_profile_bytes", 99), ("max_icc_chunks", 1), ("max_icc_tags", 0),
    ("max_photoshop_resources", 0), ("max_photoshop_payload_bytes", 9), ("max_photoshop_resource_bytes", 1), ("max_iptc_data_bytes", 1), ("max_iptc_datasets", 1),
    ("max_iptc_value_bytes", 1), ("max_iptc_length_octets", 1),
]


def budget_photo(row: dict) -> bytes:
    """A byte that numbers the case, and a photo with something of everything that a budget bounds; case 3 has fill bytes, case 23 a long length."""
    import struct

    from lumenlake.kernels import forge as f
    from lumenlake.kernels.jpeg import PHOTOSHOP_ID

    k = row["k"] % BUDGETS
    parts = [f.exif([*MADE, (0x011A, 5, (72, 1))], [(0x9003, 2, "2020:01:02 03:04:05")]), f.xmp({"xmp:CreatorTool": "T", "xmp:Rating": "1"}), *f.icc(f.icc_profile("P"), 2)]
    if k == 23:
        data = struct.pack(">BBBH", 0x1C, 2, 25, 0x8004) + struct.pack(">I", 3) + b"key"
        parts.append(f.segment(0xED, PHOTOSHOP_ID + b"8BIM" + struct.pack(">H", 0x0404) + b"\0\0" + struct.pack(">I", len(data)) + data + b"\0" * (len(data) % 2)))
    else:
        parts.append(f.iptc([(2, 25, b"key"), (2, 90, b"City")]))
    data = f.jpeg(parts, 32, 16)
    return bytes([k]) + (data[:2] + b"\xff\xff" + data[2:] if k == 3 else data)


def within_budget(data: bytes) -> dict:
    """The first error of a ``budget_photo`` under its case's budget."""
    from dataclasses import replace

    from lumenlake.kernels.limits import DEFAULT
    from lumenlake.kernels.photo import parse

    name, value = LOWERED[data[0]]
    errors = parse(data[1:], replace(DEFAULT, **{name: value}), frozenset({"tags", "xmp", "iptc", "icc", "errors"}))["errors"]
    return {"part": errors[0]["part"] if errors else "", "message": errors[0]["message"] if errors else "", "errors": len(errors)}


def packet_photo(row: dict) -> bytes:
    """XMP packets with the forms of values, several packets, an extended one, and datasets without a declared character set."""
    from lumenlake.kernels import forge as f
    from lumenlake.kernels.jpeg import XMP_EXT_ID, XMP_ID

    k = row["k"] % PACKETS
    spaces = 'xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:xmpMM="http://ns.adobe.com/xap/1.0/mm/" xmlns:z="urn:z"'

    def packet(body: str) -> bytes:
        rdf = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">'
        return f.segment(0xE1, XMP_ID + f'<x:xmpmeta xmlns:x="adobe:ns:meta/">{rdf}<rdf:Description {spaces}>{body}</rdf:Description></rdf:RDF></x:xmpmeta>'.encode())

    item = lambda lang, text: f'<rdf:li xml:lang="{lang}">{text}</rdf:li>'
    parts = [
        lambda: [f.xmp({"xmp:Rating": str(row["k"] % 6)}), packet(f"<dc:title><rdf:Alt>{item('es', 'otro')}{item('x-default', 'bueno')}</rdf:Alt></dc:title><dc:subject><rdf:Bag><rdf:li>a</rdf:li><rdf:li> </rdf:li><rdf:li>b</rdf:li></rdf:Bag></dc:subject>"), f.segment(0xE1, XMP_EXT_ID + b"more")],
        lambda: [packet('<xmpMM:DerivedFrom rdf:resource="r1"/>')], lambda: [packet(f"<dc:title><rdf:Alt>{item('es', 'primero')}{item('de', 'zwei')}</rdf:Alt></dc:title>")],
        lambda: [packet(" <z:thing> t </z:thing> ")], lambda: [packet("<dc:rights></dc:rights>"), f.segment(0xE1, XMP_ID + b"<broken")],
        lambda: [f.iptc([(2, 25, "Öl".encode("latin-1")), (2, 200, b"?")])],
    ][k]()
    return f.jpeg(parts, 8, 8)


def chunk_photo(row: dict) -> bytes:
    """A profile in one, two or three chunks, some out of order, missing, doubled, at odds or badly numbered; in case 8 none."""
    from lumenlake.kernels import forge as f
    from lumenlake.kernels.jpeg import ICC_ID

    k = row["k"]
    profile = f.icc_profile(f"P{k}")
    chunk = lambda no, of, data: f.segment(0xE2, ICC_ID + bytes((no, of)) + data)
    a, b, c = (chunk(j + 1, 3, profile[50 * j : 50 * (j + 1)] if j < 2 else profile[100:]) for j in range(3))
    parts = {
        0: [chunk(1, 1, profile)], 1: [a, b, c], 2: [c, a, b], 3: [a, c], 4: [a, b, c, b], 5: [a, b, chunk(3, 4, profile[100:])], 6: [chunk(0, 1, profile)],
        7: [f.segment(0xE2, ICC_ID + b"\1")], 8: [f.segment(0xE2, b"other")],
    }[k % CHUNKS]
    return f.jpeg(parts, 8, 8)
