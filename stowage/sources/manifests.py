"""Checksum manifests: ``md5`` space, ``*`` or space, name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed value: the layout of one line.
LINE = r"(?s)^([0-9A-Fa-f]{32}) [* ](.+)$"
#: The first line that is not blank, without its end.
FIRST = r"^(?:\r?\n)*([^\n]*?)\r?(?:\n|\z)"


def _split(lines: DataFrame, *kept: str) -> DataFrame:
    """Non-blank lines with hash and name; bad lines have no hash."""
    return (lines.withColumn("line", F.regexp_replace("raw", "\r$", ""))
            .where(F.col("line") != "")
            .select("folder", *kept, "line",
                    F.when(F.col("line").rlike(LINE),
                           F.lower(F.regexp_extract("line", LINE, 1))).alias("md5"),
                    F.when(F.col("line").rlike(LINE),
                           F.regexp_extract("line", LINE, 2)).alias("name")))


def manifest_lines(documents: DataFrame) -> DataFrame:
    """Non-blank lines of (folder, value), with position, hash and name; bad lines have no hash."""
    return _split(documents.select("folder", F.posexplode(F.split("value", "\n")).alias("line_no", "raw")), "line_no")


def _complaint(line):
    shown = F.when(F.length(line) <= 80, line).otherwise(
        F.concat(F.substr(line, F.lit(1), F.lit(80)), F.lit("...")))
    return F.concat(F.lit("Unexpected line in an md5sum response: '"), shown, F.lit("'."))


def _hashed(lines: DataFrame, strict: bool, order: str) -> DataFrame:
    """(folder, name, md5) of lines with folder, line, md5, name and their order; the last of one name counts."""
    if strict:
        md5 = F.coalesce("md5", F.raise_error(_complaint(F.col("line"))).cast("string"))
        lines = lines.withColumn("md5", md5)
    else:
        lines = lines.where(F.col("md5").isNotNull())
    return lines.groupBy("folder", "name").agg(F.max_by("md5", order).alias("md5"))


def parse_md5_manifest(documents: DataFrame, strict: bool = True) -> DataFrame:
    """(folder, name, md5) of manifests held as (folder, value); a later duplicate wins.

    A strict read fails on the first bad line; a lenient one leaves it to ``manifest_errors``.
    """
    return _hashed(manifest_lines(documents), strict, "line_no")


def manifest_errors(documents: DataFrame) -> DataFrame:
    """The whole lines a lenient read left out, and what to say about them."""
    return (manifest_lines(documents).where(F.col("md5").isNull())
            .select("folder", "line_no", "line", _complaint(F.col("line")).alias("problem")))


def parse_md5_single(documents: DataFrame, strict: bool = True) -> DataFrame:
    """The hash of each document's first non-blank line; NULL for an empty document."""
    first = F.regexp_extract("value", FIRST, 1)
    line = F.when(first != "", first)
    md5 = F.when(line.rlike(LINE), F.lower(F.regexp_extract(line, LINE, 1)))
    if strict:
        md5 = F.when(line.isNotNull(), F.coalesce(
            md5, F.raise_error(_complaint(line)).cast("string")))
    return documents.select("folder", md5.alias("md5"))


def _place() -> Column:
    # A manifest stands for the folder it is named after; the reader reports names as URIs.
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("folder")


def read_md5_manifest(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Manifests as files, read line by line: a large one is as many tasks as it has splits.

    Which of two lines for one name comes later is told by the split's place in the file and the line's in the split.
    """
    text = spark.read.text(path, lineSep="\n", recursiveFileLookup=True)
    # A split is read by one task from its start to its end, so its rows are numbered in order.
    order = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return _hashed(_split(text.select(_place(), F.col("value").alias("raw"), order.alias("at")), "at"), strict, "at")


def read_md5_single(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Documents of one line as files; an empty one has no hash."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return parse_md5_single(text.select(_place(), "value"), strict)
