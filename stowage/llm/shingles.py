"""Word shingles as DataFrame expressions, for operators that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What separates words: white space, or everything but letters and digits.
BLANKS, MARKS = r"[\x20\x09-\x0D]+", r"[^\p{L}\p{N}]+"


def words(text: Column, between: str = BLANKS) -> Column:
    """Words of a text with A-Z lower-cased; null and blank texts have none."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    parts = F.split(lowered, between)
    # Only the first and the last part can be empty.
    start = F.when(F.get(parts, F.lit(0)) == "", 2).otherwise(1)
    drop = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.slice(parts, start, F.greatest(F.size(parts) - start + 1 - drop, F.lit(0)))


def shingles(name: str) -> Column:
    """Hashes of each ``WIDTH`` consecutive words of an array column; of all of them if there are fewer."""
    w = F.col(name)
    more = lambda i: [F.get(w, i + k) for k in range(1, WIDTH)]
    runs = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (WIDTH - 1), F.lit(0))),
                       lambda x, i: F.xxhash64(x, *more(i)))
    return F.when(F.size(w) >= WIDTH, runs).when(
        F.size(w) > 0, F.array(F.xxhash64(F.lit(0), F.concat_ws(" ", w)))).otherwise(
        F.array().cast("array<bigint>"))


def sql_shingles(table: str, key: str, between: str = r"[^\x20\x09-\x0D]+") -> str:
    """The same sets in DuckDB's SQL: distinct (key, s), as text."""
    text = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    return (f"SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= {WIDTH} THEN list_transform(range(1, len(w) - {WIDTH - 2}), "
            f"lambda i: array_to_string(w[i:i+{WIDTH - 1}], ' ')) WHEN len(w) > 0 THEN ['< ' || array_to_string(w, ' ')] "
            f"ELSE [] END) AS s FROM (SELECT {key}, regexp_extract_all({text}, '{between}') AS w FROM {table})")
