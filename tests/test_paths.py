from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stowage.functions import paths as P
from stowage.functions.rules import candidate_filter, parse_server_time

ROOT = "/_webdav/lab/@files/uploads/"


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize("plain, encoded", [
    ("tide7.bin", "tide7.bin"), ("two  words", "two%20%20words"), ("3+4", "3%2B4"), ("naïve", "na%C3%AFve"),
    ("9%25 off", "9%2525%20off"), ("@dock", "@dock"), ("~lo_hi-2.z", "~lo_hi-2.z"), ("left;right", "left%3Bright"),
    ("glow*", "glow%2A"), ("u=1&v", "u%3D1%26v"), ("why?#9", "why%3F%239"), ("東西", "%E6%9D%B1%E8%A5%BF"),
    ("{k}'$", "%7Bk%7D%27%24"),
])
def test_encode_and_decode_segment(spark, plain, encoded):
    assert one(spark, plain, P.encode_segment) == encoded
    assert one(spark, encoded, P.percent_decode) == plain


@pytest.mark.parametrize("text, expected", [
    ("100% sure", "100% sure"), ("a%2", "a%2"), ("a%20b%zz", "a b%zz"), ("a+b%20c", "a+b c"),
    ("%FF%41", "%FFA"), ("%C3%28", "%C3("), ("%EF%BF%BD", "�"), ("%ED%A0%80", "%ED%A0%80"),
])
def test_stray_escapes_stay(spark, text, expected):
    assert one(spark, text, P.percent_decode) == expected


@pytest.mark.parametrize("text, segments, collection, encoded", [
    ("/a/b/", ["a", "b"], True, "/a/b/"), ("a\\b c", ["a", "b c"], False, "/a/b%20c"),
    ("", [], True, "/"), ("/", [], True, "/"), ("//a/./b", ["a", "b"], False, "/a/b"),
    ("a%20b/c", ["a b", "c"], False, "/a%20b/c"), (".", [], True, "/"),
])
def test_parse_remote_path(spark, text, segments, collection, encoded):
    frame = spark.createDataFrame([(text,)], "c string").select(
        P.parse_remote_path(F.col("c")).alias("p")).select("p", P.encode_path(F.col("p")).alias("e"))
    row = frame.first()
    assert (row.p.segments, row.p.is_collection, row.p.error, row.e) == (
        segments, collection, None, encoded)


@pytest.mark.parametrize("text", ["a/../b", "..", "a/%2E%2E/b"])
def test_parent_segments_are_refused(spark, text):
    row = one(spark, text, P.parse_remote_path)
    assert row.segments is None and "'..' is not allowed" in row.error


def test_from_segments_and_append(spark):
    base = P.from_segments(F.array(F.lit("a"), F.lit(""), F.lit("."), F.lit("b")), True)
    row = spark.range(1).select(
        base.alias("base"), P.append_path(base, F.lit("c;1")).alias("more"),
        P.append_path(base, F.lit(".")).alias("dot"), P.append_path(base, F.lit("x/y")).alias("slash"),
        P.from_segments(F.array(F.lit("a\\b"))).alias("bad"),
        P.append_relative(base, P.from_segments(F.array(F.lit("r")))).alias("rel")).first()
    assert row.base.segments == ["a", "b"] and row.base.is_collection
    assert row.more.segments == ["a", "b", "c;1"]
    assert row.dot.error and row.slash.error and row.bad.error
    assert row.rel.segments == ["a", "b", "r"] and not row.rel.is_collection


@pytest.mark.parametrize("path, root, under", [
    ("/d/run10/x.raw", "/d/run1/", False), ("/d/run1/x.raw", "/d/run1/", True),
    ("/d/run1", "/d/run1/", True), ("/d/RUN1/x", "/d/run1/", False), ("/d", "/d/run1", False),
    ("/any", "/", True),
])
def test_is_under(spark, path, root, under):
    row = spark.createDataFrame([(path, root)], "a string, b string").select(P.is_under(
        P.parse_remote_path(F.col("a")), P.parse_remote_path(F.col("b"))).alias("r")).first()
    assert row.r is under


def test_uri_keeps_the_base_path(spark):
    path = P.parse_remote_path(F.lit("/_webdav/a b.raw"))
    row = spark.range(1).select(P.to_uri(path, F.lit("https://host:8443/base/")).alias("u"),
                                P.to_uri(path, F.lit("HTTPS://host")).alias("v")).first()
    assert row.u == "https://host:8443/base/_webdav/a%20b.raw"
    assert row.v == "https://host/_webdav/a%20b.raw"


@pytest.mark.parametrize("name, reason", [
    ("tide7.bin", "None"), ("", "Empty"), (" \t ", "Empty"), ("\u2003", "Empty"), (None, "Empty"),
    (".", "Traversal"), ("..", "Traversal"), ("left;right.bin", "SemicolonTruncatesOnServer"),
    ("12:45", "IllegalCharacter"), ("or|", "IllegalCharacter"), ("q\x02r", "IllegalCharacter"),
    ("x" * 255, "None"), ("x" * 256, "TooLong"), ("\U0001F600" * 128, "TooLong"),
    ("\U0001F600" * 127, "None"), ("...", "None"), (";" + "x" * 300, "SemicolonTruncatesOnServer"),
    ("x" * 300 + ":", "TooLong"),
])
def test_validate_segment(spark, name, reason):
    assert one(spark, name, P.validate_segment).reason == reason


def test_semicolon_message_names_what_would_be_stored(spark):
    message = one(spark, "left;right.bin", P.validate_segment).message
    assert "would be stored as 'left'" in message


@pytest.mark.parametrize("path, destination, reason", [
    (r"C:\Data\spring\low tide\tide7.bin", ROOT + "spring/low%20tide/tide7.bin", "None"),
    (r"c:\DATA\tide7.bin", ROOT + "tide7.bin", "None"),
    ("C:/Data/a%20b.raw", ROOT + "a%20b.raw", "None"),
    ("C:/Data/.hidden/x.raw", ROOT + ".hidden/x.raw", "None"),
    ("C:/Data/" + "y" * 200 + "/x.raw", ROOT + "y" * 200 + "/x.raw", "None"),
    (r"C:\Datum\tide7.bin", None, "OutsideBase"), (r"E:\tide7.bin", None, "OutsideBase"),
    ("C:/Data/..tide", None, "OutsideBase"), ("C:/Data", None, "Traversal"),
    ("C:/Data/left;right", None, "SemicolonTruncatesOnServer"),
    ("C:/Data/q%3Bx.raw", ROOT + "q%3Bx.raw", "None"),
    ("C:/Data/x/%2E%2E/y.raw", None, "Traversal"),
    ("C:/Data//d/ /x.raw", None, "Empty"),
    ("C:/Data/" + "z" * 256, None, "TooLong"),
])
def test_destination(spark, path, destination, reason):
    frame = spark.createDataFrame([(path,)], "path string")
    row = P.with_destination(frame, r"C:\Data", ROOT).first()
    assert (row.destination, row.reason) == (destination, reason)
    assert (row.message is None) == (reason == "None")
    if destination:
        assert row.folder == destination.rsplit("/", 1)[0] + "/"
    alone = frame.select(P.resolve_destination(F.col("path"), r"C:\Data", ROOT).alias("d")).first()
    assert alone.d == destination
    kept = P.with_destination(frame, r"C:\Data", ROOT, resolved_only=True).count()
    assert kept == (1 if destination else 0)


@pytest.mark.parametrize("path, accepted", [
    ("E:/q/TIDE7.RAW", True), ("ebb.flow.raw", True), ("ebb.xraw", False), ("q/.ebb.raw", False),
    ("~ebb.raw", False), ("q\\ebb.wiff", True), ("raw", False), ("ebb.raw/", False), ("ebb.", False),
])
def test_candidate_filter(spark, path, accepted):
    assert one(spark, path, lambda c: candidate_filter(c, [".raw", ".WIFF"])) is accepted


def test_no_extensions_accept_all(spark):
    assert one(spark, "a/b.txt", lambda c: candidate_filter(c)) is True


def test_extensions_and_drives(spark):
    assert one(spark, "raw, .WIFF;mzML raw", P.normalise_extensions) == [".raw", ".wiff", ".mzml"]
    share = F.lit("\\\\nas\\share\\")
    assert one(spark, "P:\\a\\b", lambda c: P.map_drive_path(c, share)) == "\\\\nas\\share\\a\\b"
    assert one(spark, "P:", lambda c: P.map_drive_path(c, share)) == "\\\\nas\\share\\"
    assert one(spark, "P:\\a", lambda c: P.map_drive_path(c, F.lit(None).cast("string"))) == "P:\\a"


@pytest.mark.parametrize("text, utc_ms", [
    ("2031-07-09T03:04:05Z", 1941332645000), ("2031-07-09 03:04:05.5+01:00", 1941329045500),
    ("2031-07-09T03:04", 1941332640000), ("2031-07-09T03:04:05", 1941332645000),
    ("Wed, 09 Jul 2031 03:04:05 GMT", 1941332645000), ("03:04", None), ("2031-07-09", None), ("soon", None),
    (None, None), ("Wed, 39 Jul 2031 03:04:05 GMT", None),
])
@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_server_time_depends_on_its_text_only(spark, text, utc_ms, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert one(spark, text, lambda c: F.unix_millis(parse_server_time(c))) == utc_ms
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
