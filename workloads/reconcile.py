"""Sweep, decision ladder and destinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stowage.functions import paths as P
from stowage.functions.rules import (
    candidate_filter, implied_verification, is_settled, is_settled_at)
from stowage.operators import ladder, sweep as S
from workloads import sqltext as Q
from workloads.fixtures import BASE, DUCK, ROOT, cte, inventory, ledger, remote, view
from workloads.registry import query


def swept(spark, d) -> DataFrame:
    return S.sweep(inventory(spark, d), ledger(spark, d), BASE, ROOT)


def files(spark, d) -> DataFrame:
    return ladder.located(S.candidates(inventory(spark, d)), BASE, ROOT)


def snapshot(spark, d) -> DataFrame:
    rows = remote(spark, d)
    return ladder.remote_snapshot(rows, rows.where(F.col("md5").isNotNull()))


def hash_by_name(rows: DataFrame) -> DataFrame:
    """Stands in for reading the files: their bytes are a function of the order key."""
    key = F.regexp_extract("path", r"acq_(\d+)", 1)
    content = F.when(key.cast("bigint") % 13 == 0, F.concat(F.lit("y"), key)).otherwise(key)
    return rows.withColumn("md5", F.md5(content)).withColumn("sha256", F.lit(None).cast("string"))


def decisions(spark, d, policy: Column | int = 0) -> DataFrame:
    return ladder.decide(files(spark, d), ledger(spark, d), snapshot(spark, d), None,
                         hash_by_name, policy)


def classified(spark, d) -> DataFrame:
    return ladder.classify(files(spark, d), ledger(spark, d), snapshot(spark, d))


def joined(spark, d) -> DataFrame:
    rows = S.join_ledger(S.candidates(inventory(spark, d)), ledger(spark, d),
                         ("remote_path", "size", "mtime_utc", "state", "verify_method"))
    return (rows.where("l_known")
            .withColumn("destination", P.resolve_destination(F.col("path"), BASE, ROOT)))


_SETTLED_SQL = ("state IN (4, 5) AND verify_method = 2 AND size = length AND mtime_utc = mtime_ms")


@query("candidate_filter", cte("fx_inventory") + f"""
SELECT path, length, mtime_ms FROM fx_inventory
WHERE {Q.KEPT} AND (lower(name) LIKE '%.raw' OR lower(name) LIKE '%.wiff')""")
def _(spark, d):
    return inventory(spark, d).where(candidate_filter(F.col("path"), [".RAW", ".wiff"]))


@query("sweep", Q.SWEPT + " SELECT path, length, mtime_ms, destination, accounted FROM swept")
def _(spark, d):
    return swept(spark, d)


@query("sweep_summary", Q.SWEPT + """
SELECT count(*) AS examined, count(*) FILTER (NOT accounted) AS offered,
       count(*) FILTER (accounted) AS accounted FROM swept""")
def _(spark, d):
    return S.sweep_summary(swept(spark, d))


@query("is_settled", Q.SWEPT + f"""
SELECT path, coalesce({_SETTLED_SQL}, false) AS settled FROM joined WHERE local_path IS NOT NULL""")
def _(spark, d):
    rows = joined(spark, d)
    return rows.select("path", is_settled(
        rows.l_state, rows.l_verify_method, rows.l_size, rows.l_mtime_utc, rows.length,
        rows.mtime_ms).alias("settled"))


@query("is_settled_at", Q.SWEPT + f"""
SELECT path, destination, coalesce({_SETTLED_SQL} AND remote_path = destination, false) AS settled
FROM joined WHERE local_path IS NOT NULL""")
def _(spark, d):
    rows = joined(spark, d)
    return rows.select("path", "destination", is_settled_at(
        rows.l_state, rows.l_verify_method, rows.l_size, rows.l_mtime_utc, rows.l_remote_path,
        rows.length, rows.mtime_ms, rows.destination).alias("settled"))


@query("is_accounted_for", Q.SWEPT + """
SELECT accounted, count(*) AS files, sum(length) AS bytes FROM swept GROUP BY accounted""")
def _(spark, d):
    return swept(spark, d).groupBy("accounted").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


@query("ledger_lookup", cte("fx_inventory", "fx_ledger") + """
SELECT local_path, remote_path, size, state FROM fx_ledger
WHERE lower(local_path) IN (SELECT lower(path) FROM fx_inventory WHERE length % 3 = 0)""")
def _(spark, d):
    asked = inventory(spark, d).where("length % 3 = 0")
    return S.ledger_lookup(ledger(spark, d), asked).select(
        "local_path", "remote_path", "size", "state")


@query("tier0_settled", Q.decided() + """
SELECT path, destination, action, tier, reason, remote_hash FROM decided WHERE tier = 0""")
def _(spark, d):
    return ladder.tier0_settled(files(spark, d), ledger(spark, d))


@query("tier1_remote", Q.decided() + f" SELECT {Q.DECISION_COLUMNS} FROM decided WHERE tier = 1")
def _(spark, d):
    return ladder.tier1_remote(classified(spark, d))


@query("tier2_hash", Q.decided() + f" SELECT {Q.DECISION_COLUMNS} FROM decided WHERE tier = 2")
def _(spark, d):
    return ladder.tier2_hash(classified(spark, d), ledger(spark, d), None, hash_by_name)


@query("remote_is_ours", Q.decided() + " SELECT path, step IN ('size_ours', 'hash_ours') OR ours AS ours FROM stepped")
def _(spark, d):
    return classified(spark, d).select("path", "ours")


@query("decide", Q.decided() + f" SELECT {Q.DECISION_COLUMNS} FROM decided")
def _(spark, d):
    return decisions(spark, d)


@query("conflict_policy", Q.decided("(s.length % 4)") + f" SELECT {Q.DECISION_COLUMNS} FROM decided")
def _(spark, d):
    return decisions(spark, d, F.col("length") % 4)


@query("implied_verification", Q.decided("(s.length % 4)") + """
SELECT action, CASE WHEN action = 'Skip' AND remote_hash IS NOT NULL THEN 2 ELSE 0 END AS verification,
       count(*) AS files FROM decided GROUP BY ALL""")
def _(spark, d):
    rows = decisions(spark, d, F.col("length") % 4)
    return (rows.groupBy("action", implied_verification(F.col("action"), F.col("remote_hash"))
                         .alias("verification")).agg(F.count(F.lit(1)).alias("files")))


@query("tier_counts", Q.decided() + """
SELECT tier, action, count(*) AS files FROM decided GROUP BY tier, action""")
def _(spark, d):
    return ladder.tier_counts(decisions(spark, d))


@query("cached_hashes", cte("fx_inventory", "fx_ledger") + """
SELECT i.path, i.length, i.mtime_ms, l.md5, cast(NULL as string) AS sha256, l.md5 IS NOT NULL AS hit
FROM fx_inventory i LEFT JOIN fx_ledger l ON lower(i.path) = lower(l.local_path)
 AND i.length = l.size AND i.mtime_ms = l.mtime_utc AND l.md5 IS NOT NULL""")
def _(spark, d):
    cache = ledger(spark, d).select("local_path", "size", "mtime_utc", "md5", "sha256")
    return ladder.cached_hashes(inventory(spark, d), cache)


@query("cached_twins", cte("fx_inventory", "fx_ledger") + """
SELECT i.path, CASE WHEN l.first_seen_seq % 5 <> 0 THEN l.md5 END AS md5,
  l.md5 IS NOT NULL AND l.first_seen_seq % 5 <> 0 AS hit
FROM fx_inventory i LEFT JOIN fx_ledger l ON lower(i.path) = lower(l.local_path)
 AND i.length = l.size AND i.mtime_ms = l.mtime_utc AND l.md5 IS NOT NULL""")
def _(spark, d):
    """A cache that holds every key twice, in another case, and for some of them another hash too."""
    known = ledger(spark, d).select("local_path", "size", "mtime_utc", "md5", "sha256", "first_seen_seq")
    other = known.withColumn("local_path", F.upper("local_path")).withColumn("md5", F.upper("md5"))
    wrong = known.where("first_seen_seq % 5 = 0 AND md5 IS NOT NULL").withColumn("md5", F.lit("0" * 32))
    cache = known.unionByName(other).unionByName(wrong)
    return ladder.cached_hashes(inventory(spark, d), cache).select("path", F.lower("md5").alias("md5"), "hit")


@query("find_by_content", cte("fx_contents") + """
SELECT c.path, c.length, c.md5, s.path AS already_uploaded_as FROM fx_contents c
LEFT JOIN (SELECT length, md5, min_by(path, doc_id) AS path FROM fx_contents
           WHERE doc_id % 3 = 0 GROUP BY length, md5) s ON s.length = c.length AND s.md5 = c.md5""")
def _(spark, d):
    contents = view(spark, d, "fx_contents").select("doc_id", "path", "length", "md5")
    known = contents.where("doc_id % 3 = 0").select(
        F.col("path").alias("local_path"), F.col("length").alias("size"), "md5",
        F.lit(4).alias("state"), F.lit(2).alias("verify_method"),
        F.col("doc_id").alias("first_seen_seq"))
    return ladder.find_by_content(contents.drop("doc_id"), known)


@query("superseded_filter", cte("fx_inventory") + """
SELECT path, length AS length_before, length + (k % 5) AS length_after FROM fx_inventory
WHERE k % 5 <> 0 OR k % 7 = 0""")
def _(spark, d):
    rows = view(spark, d, "fx_inventory")
    sent = rows.select("path", "length", "mtime_ms")
    fresh = rows.selectExpr("upper(path) as path", "length + (k % 5) as length",
                            "mtime_ms + case when k % 7 = 0 then 1 else 0 end as mtime_ms")
    return S.superseded(sent, fresh).select(
        "path", F.col("length").alias("length_before"), "length_after")


@query("recover_interrupted", cte("fx_inventory", "fx_ledger") + """
SELECT local_path, CASE WHEN i.path IS NOT NULL THEN 'requeue' ELSE 'fail' END AS action,
       CASE WHEN i.path IS NULL THEN 'The local file no longer exists.' END AS last_error
FROM fx_ledger l LEFT JOIN fx_inventory i ON lower(i.path) = lower(l.local_path)
WHERE state IN (1, 2, 3)""")
def _(spark, d):
    return S.recover_interrupted(ledger(spark, d), inventory(spark, d))


@query("in_flight_gate", cte("fx_inventory", "fx_ledger") + """
SELECT path FROM fx_inventory WHERE lower(path) NOT IN
 (SELECT lower(local_path) FROM fx_ledger WHERE state = 2)""")
def _(spark, d):
    offered = inventory(spark, d).select("path")
    twice = offered.unionByName(offered.where(F.length("path") % 2 == 0))
    busy = ledger(spark, d).where("state = 2").select(F.col("local_path").alias("path"))
    return S.in_flight_gate(twice, busy)


@query("union_candidates", cte("fx_inventory", "fx_ledger") + """
SELECT path FROM fx_inventory UNION ALL
SELECT local_path FROM fx_ledger WHERE state <> 4
 AND lower(local_path) NOT IN (SELECT lower(path) FROM fx_inventory)""")
def _(spark, d):
    noticed = ledger(spark, d).where("state <> 4").select(F.col("local_path").alias("path"))
    return S.union_candidates(inventory(spark, d), noticed)


@query("destination_plan", cte("fx_inventory") + f"""
SELECT path, length, mtime_ms, {Q.DEST} AS destination,
  CASE WHEN name NOT LIKE '%;%' THEN '{ROOT}' || folder || '/' END AS folder,
  CASE WHEN name NOT LIKE '%;%' THEN name END AS name,
  CASE WHEN name LIKE '%;%' THEN 'SemicolonTruncatesOnServer' ELSE 'None' END AS reason,
  CASE WHEN name LIKE '%;%' THEN '''' || name || ''' contains a semicolon. The server truncates the name at the first semicolon, so this would be stored as '''
   || split_part(name, ';', 1) || ''' and could silently overwrite another file. Rename it before uploading.' END AS message
FROM fx_inventory""")
def _(spark, d):
    return S.destination_plan(inventory(spark, d), BASE, ROOT)


def _raw_segments(rows: DataFrame) -> DataFrame:
    """Destinations as the server would be asked for them, unchecked names included."""
    rel = P.relative_path(F.col("path"), BASE)
    return rows.withColumn("segments", F.split(rel, "/"))


@query("destination_folders", cte("fx_inventory") + """
SELECT DISTINCT folder, depth FROM (
  SELECT folder, 2 AS depth FROM fx_inventory UNION ALL
  SELECT split_part(folder, '/', 1), 1 FROM fx_inventory)""")
def _(spark, d):
    return S.destination_folders(_raw_segments(inventory(spark, d))).select(
        F.array_join("segments", "/").alias("folder"), "depth").orderBy("depth", "folder")


@query("stored_name_collisions", cte("fx_inventory") + """,
s AS (SELECT path, split_part(folder, '/', 1) || '/run/' || split_part(name, ';', 1) AS stored,
             split_part(folder, '/', 1) || '/run/' || name AS destination_path
      FROM (SELECT path, folder, CASE WHEN k % 23 = 0 THEN regexp_replace(name, 'acq_[0-9]+', 'acq_' || (k % 50)) ELSE name END AS name FROM fx_inventory))
SELECT stored, path, destination_path,
  cast(count(*) OVER (PARTITION BY stored) as bigint) AS sources,
  count(*) OVER (PARTITION BY destination_path) > 1 AS decoded_collision
FROM s QUALIFY count(*) OVER (PARTITION BY stored) > 1""")
def _(spark, d):
    rows = view(spark, d, "fx_inventory")
    name = F.when(F.col("k") % 23 == 0, F.regexp_replace(
        "name", F.lit("acq_[0-9]+"), F.concat(F.lit("acq_"), (F.col("k") % 50).cast("string")))
    ).otherwise(F.col("name"))
    segments = F.array(F.split("folder", "/")[0], F.lit("run"), name)
    return S.stored_name_collisions(rows.select("path", segments.alias("segments")))


_ODD = ("CASE {k} % 12 WHEN 0 THEN '' WHEN 1 THEN '..' WHEN 2 THEN 'run;' || {n} "
        "WHEN 3 THEN repeat('x', 256) WHEN 4 THEN 'a:' || {n} WHEN 5 THEN 'q?' || {n} "
        "WHEN 6 THEN '  ' WHEN 7 THEN '.' WHEN 8 THEN 'c' || chr(1) || 'd' ELSE {n} END")


@query("validate_segment", cte("fx_orders") + f""",
odd AS (SELECT k, {_ODD.format(k='k', n='name')} AS n FROM fx_orders)
SELECT k, CASE k % 12 WHEN 0 THEN 'Empty' WHEN 6 THEN 'Empty' WHEN 1 THEN 'Traversal' WHEN 7 THEN 'Traversal'
  WHEN 3 THEN 'TooLong' ELSE CASE WHEN n LIKE '%;%' THEN 'SemicolonTruncatesOnServer'
    WHEN k % 12 IN (4, 5, 8) THEN 'IllegalCharacter' ELSE 'None' END END AS reason,
 CASE WHEN k % 12 IN (0, 6) THEN 'The name is empty.'
  WHEN k % 12 IN (1, 7) THEN '''' || n || ''' is a relative path segment and cannot be used as a name.'
  WHEN k % 12 = 3 THEN 'The name is 256 characters; the limit is 255.'
  WHEN n LIKE '%;%' THEN '''' || n || ''' contains a semicolon. The server truncates the name at the first semicolon, so this would be stored as '''
   || split_part(n, ';', 1) || ''' and could silently overwrite another file. Rename it before uploading.'
  WHEN k % 12 = 4 THEN '''' || n || ''' contains '':'', which cannot be used in a remote name.'
  WHEN k % 12 = 5 THEN '''' || n || ''' contains ''?'', which cannot be used in a remote name.'
  WHEN k % 12 = 8 THEN 'The name contains a control character.' END AS message
FROM odd""")
def _(spark, d):
    odd = view(spark, d, "fx_orders").selectExpr("k", f"{_ODD.format(k='k', n='name')} as n")
    return odd.withColumn("v", P.validate_segment(F.col("n"))).select("k", "v.reason", "v.message")


@query("parse_remote_path", """
WITH p AS (SELECT page_id, url, list_filter(string_split(url, '/'), lambda s: s <> '') AS segments FROM pages)
SELECT page_id, len(segments) AS depth, segments[len(segments)] AS name,
  url LIKE '%/' AS is_collection,
  '/' || array_to_string(list_transform(segments, lambda s: replace(url_encode(s), '%40', '@')), '/')
   || CASE WHEN url LIKE '%/' THEN '/' ELSE '' END AS encoded,
  '/' || array_to_string(list_transform(segments[1:len(segments)-1], lambda s: replace(url_encode(s), '%40', '@') || '/'), '') AS parent,
  len(segments) >= 2 AND segments[1] = 'https:' AS under_https,
  'https://host.example/base' || '/' || array_to_string(list_transform(segments, lambda s: replace(url_encode(s), '%40', '@')), '/')
   || CASE WHEN url LIKE '%/' THEN '/' ELSE '' END AS uri
FROM p""")
def _(spark, d):
    rows = (spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url")
            .withColumn("p", P.parse_remote_path(F.col("url"))))
    p = F.col("p")
    https = P.from_segments(F.array(F.lit("https:")), is_collection=True)
    return rows.select(
        "page_id", F.size(p.segments).cast("bigint").alias("depth"), P.path_name(p).alias("name"),
        p.is_collection.alias("is_collection"), P.encode_path(p).alias("encoded"),
        P.encode_path(P.path_parent(p)).alias("parent"), P.is_under(p, https).alias("under_https"),
        P.to_uri(p, F.lit("https://host.example/base/")).alias("uri"))


@query("percent_decode", f"""
SELECT doc_id, md5(text) AS decoded_md5 FROM documents""")
def _(spark, d):
    # Encoding a whole text and decoding it again gives it back.
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.md5(P.percent_decode(P.encode_segment(F.col("text"))))
                       .alias("decoded_md5"))


@query("normalise_extensions", """
SELECT s_suppkey, '.' || lower(split_part(s_name, '#', 1)) || ',.' || s_nationkey || 'x' AS extensions
FROM supplier""")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/supplier.parquet")
    first = F.split("s_name", "#")[0]
    text = F.concat(first, F.lit(", ."), F.upper(first), F.lit(";"),
                    F.col("s_nationkey").cast("string"), F.lit("X"))
    return rows.select("s_suppkey", F.array_join(P.normalise_extensions(text), ",")
                       .alias("extensions"))
