"""Folder listings: JSON documents with a ``files`` array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stowage.functions.paths import encode_segment
from stowage.functions.rules import parse_server_time, split_methods

# What is said of a document that is no listing.
NOT_JSON = ("The server did not return a JSON directory listing. This usually means the request "
            "was not authenticated.")
NO_FILES = "The directory listing contained no 'files' array."


def _without_trailing_commas(value: Column) -> Column:
    """Drops commas before a closing bracket, leaving quoted text alone."""
    return F.when(value.rlike(r",\s*[\]}]"), F.regexp_replace(
        value, r'("(?:[^"\\]++|\\.)*+")|,(?=\s*[\]}])', "$1")).otherwise(value)


def _folded(entry: Column) -> Column:
    """Field names in lower case, because servers differ in it; the later of two wins."""
    return F.transform_keys(entry, lambda k, _: F.lower(k))


def parse_listings(documents: DataFrame) -> DataFrame:
    """One row per entry of (folder, value); a document that is no listing gives one row with
    ``problem`` set. ``folder`` is the encoded path of the listed folder.

    Entries are read as maps of text: field names may differ in case and numbers may be quoted.
    """
    top = _folded(F.from_json(_without_trailing_commas(F.col("value")), "map<string,string>"))
    parsed = (documents.select("folder", top.alias("top"))
              .select("folder", "top", F.col("top")["files"].alias("text"))
              .select("folder", "top", "text",
                      F.from_json("text", "array<map<string,string>>").alias("files")))
    problem = (F.when(F.col("top").isNull(), NOT_JSON)
               .when(F.col("text").isNull(), NO_FILES)
               .when(F.col("files").isNull(), NOT_JSON))
    named = F.filter(F.transform("files", _folded), lambda e: F.coalesce(e["text"], F.lit("")) != "")
    # Entries and problem come out of one generator: a condition on either would else be moved below it and, spelt out
    # over the text, parse each document several times more.
    nothing = F.lit(None).cast("map<string,string>")
    found = F.when(problem.isNotNull(), F.array(F.struct(problem.alias("problem"), nothing.alias("e")))).otherwise(
        F.transform(named, lambda e: F.struct(F.lit(None).cast("string").alias("problem"), e.alias("e"))))
    rows = (parsed.select("folder", F.explode_outer(found).alias("row")).select("folder", "row.problem", "row.e")
            .where(F.col("problem").isNotNull() | F.col("e").isNotNull()))

    def flag(name: str) -> Column:
        return F.coalesce(F.col("e")[name].try_cast("boolean"), F.lit(False))

    is_collection = F.coalesce(
        F.col("e")["collection"].try_cast("boolean"),
        ~F.coalesce(F.col("e")["leaf"].try_cast("boolean"), F.lit(True)))
    name = F.col("e")["text"]
    return rows.select(
        "folder", "problem", name.alias("name"),
        F.concat("folder", encode_segment(name),
                 F.when(is_collection, "/").otherwise("")).alias("path"),
        F.when(name.isNotNull(), is_collection).alias("is_collection"),
        F.when(name.isNotNull(), F.coalesce(
            F.col("e")["contentlength"].try_cast("bigint"), F.col("e")["size"].try_cast("bigint"),
            F.lit(0))).alias("length"),
        F.coalesce(parse_server_time(F.col("e")["lastmodified"]),
                   parse_server_time(F.col("e")["creationdate"])).alias("last_modified"),
        F.col("e")["etag"].alias("etag"), F.col("e")["contenttype"].alias("content_type"),
        F.col("e")["createdby"].alias("created_by"),
        F.struct(
            flag("canread").alias("can_read"), flag("canupload").alias("can_upload"),
            flag("canedit").alias("can_edit"), flag("candelete").alias("can_delete"),
            flag("canrename").alias("can_rename"),
            split_methods(F.col("e")["options"]).alias("allowed_methods")).alias("permissions"))


def listing_entries(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("problem").isNull()).drop("problem")


def listing_problems(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("problem").isNotNull()).select("folder", "problem")


def read_listing_json(spark: SparkSession, path: str, folder: Column | None = None) -> DataFrame:
    """Listing documents, one file each. ``folder`` derives the listed folder from ``file_path``;
    the default takes the file name without its suffix, as an encoded path."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    # The reader reports file names as URIs.
    location = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    default = F.concat(F.lit("/"), F.regexp_extract("file_path", r"([^/]*?)(\.json)?$", 1), F.lit("/"))
    documents = (text.select(location.alias("file_path"), "value")
                 .withColumn("folder", default if folder is None else folder))
    return parse_listings(documents.select("folder", "value"))
