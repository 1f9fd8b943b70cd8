import datetime as dt

import pytest

from lodeweave.operators import units as u

KB = 1024


@pytest.mark.parametrize(
    "text,kb",
    [
        ("2.558.712 kb", 2558712), ("18.15  GiB", 18.15 * KB**2), ("164250-Mbits", 164250 * KB / 8), ("64,67G", 64.67 * KB**2),
        ("3'323.6", 3323.6 * KB), ("59\xa0469", 59469 * KB), ("58.46 gigabytes + 505 MB", 58.46 * KB**2 + 505 * KB),
        ("6x2 136,36\xa0MB", 6 * 2136.36 * KB), ("1.728345e6  K", 1728345), ("≈5,156.74 M", 5156.74 * KB), ("2.333", 2333 * KB),
        ("10 octets", 10 / KB), ("1,5 To", 1.5 * KB**3), ("12 МБ", 12 * KB),
    ],
)
def test_quantity(text, kb):
    assert u.quantity(text, None, "MB") / KB == pytest.approx(kb)


@pytest.mark.parametrize("text", [None, "", " ", "0", "0 MB", "-1", "10-20 GB", "< 5 GB", "between 1 and 2 GB", "n/a", "?", "large"])
def test_no_case(text):
    assert u.quantity(text, None, "MB") is None


def test_stated_unit_and_amount():
    assert u.stated_unit("sizes in Go (see upload form); needs 16 GB of memory to load") == "Go"
    assert u.stated_unit("fits on a 4 TB disk") is None
    assert u.stated_amount("Total size is 2 MB; needs 16 GB of memory.") == 2 * KB**2
    assert u.stated_amount("needs 16 GB of memory") is None


def test_dimension_prior_decides_ambiguous_units():
    assert u.parse_unit("M").dimension == "information"
    metres = tuple({"length": 0.0, "information": -20.0}.items())
    assert u.parse_unit("M", metres).dimension == "length"
    assert u.parse_unit("m2", metres).exponent == 2
    assert u.parse_unit("xyz") is None


def test_compound_units():
    rate = u.parse_compound("MB/s")
    assert rate.dimension == "information/time" and rate.factor == KB**2
    assert u.parse_compound("GB per hour").factor == pytest.approx(KB**3 / 3600) and u.parse_compound("MB/xyz") is None
    assert u.parse_compound("kg·m", u.NEUTRAL).dimension == "mass·length"


@pytest.mark.parametrize("clause", ["streams at 5 MB per second", "sampled at 44 kHz, 16 bit", "16 GB of RAM", "read at 3 MB/s", "a 4 TB drive"])
def test_clauses_of_other_quantities(clause):
    assert u.stated_amount(clause) is None and u.stated_unit(clause) is None


SCHEMA = """identifier string, platform string, date_published string, extra int,
  distribution array<struct<name string, description string, content_size_kb bigint, encoding_format string>>"""


def test_asset_sizes(spark):
    item = lambda said, size: ("f", said, size, None)
    rows = [
        ("a", "p", "2020-01-01", 1, [item(None, 2048), None, item("size in MB", 3), item("total: 5 KB", None), item(None, None), item(None, 0)]),
        ("a", "p", "2020-01-01", 1, [item(None, 2048), None, item("size in MB", 3), item("total: 5 KB", None), item(None, None), item(None, 0)]),
        ("b", "p", "2022-01-01T00:00:00Z", 1, [item(None, 7)]),
        ("c", "q", None, 1, [item(None, 9)]),
        ("d", None, None, 1, None),
        (None, "p", None, 1, [item(None, 9)]),
    ]
    units = spark.createDataFrame([("p", "bytes", dt.datetime(2000, 1, 1)), ("p", "MB", dt.datetime(2021, 1, 1))], "platform string, unit string, valid_from timestamp_ntz")
    got = {tuple(r) for r in u.asset_sizes(spark.createDataFrame(rows, SCHEMA), units).collect()}
    assert got == {("a", 0, 2), ("a", 2, 3 * KB), ("a", 3, 5), ("b", 0, 7 * KB), ("c", 0, 9)}


def test_empty(spark):
    units = spark.createDataFrame([], "platform string, unit string, valid_from timestamp_ntz")
    assert u.asset_sizes(spark.createDataFrame([], SCHEMA), units).count() == 0
    assert u.metadata_sizes(spark.createDataFrame([], "meta_id long, size_in_mb string, note string")).count() == 0
