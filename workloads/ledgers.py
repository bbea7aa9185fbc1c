"""Ledger maintenance and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stowage.functions.labels import AUDIT_STATE
from stowage.functions.rules import needs_attention, trustworthy
from stowage.operators import audit as A, ledger as L
from stowage.sinks.sidecars import render_sidecar
from workloads import sqltext as Q
from workloads.fixtures import cte, inventory, ledger, table, view
from workloads.registry import query

_COLUMNS = ("local_path, remote_path, size, mtime_utc, md5, state, verify_method, attempts, "
            "last_error, first_seen_seq, epoch_us(verified_utc) // 1000 AS verified_ms")


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select(
        "local_path", "remote_path", "size", "mtime_utc", "md5", "state", "verify_method",
        "attempts", "last_error", "first_seen_seq",
        F.unix_millis("verified_utc").alias("verified_ms"))


def _updates(spark, d) -> DataFrame:
    """Whole rows for every third inventory file, new and known."""
    rows = view(spark, d, "fx_inventory").where("k % 3 < 2 and k % 4 = 0")
    return rows.selectExpr(
        "upper(path) as local_path", "concat('/new/', name) as remote_path", "length as size",
        "mtime_ms as mtime_utc", "md5(cast(k as string)) as md5", "cast(null as string) as sha256",
        "5 as state", "2 as verify_method", "timestamp_millis(mtime_ms) as verified_utc",
        "cast(k % 3 as int) as attempts", "cast(null as string) as last_error",
        "false as is_dataset", "k + 1000000000 as first_seen_seq")


@query("ledger_upsert", cte("fx_inventory", "fx_ledger") + f""",
u AS (SELECT upper(path) AS local_path, '/new/' || name AS remote_path, length AS size, mtime_ms AS mtime_utc,
        md5(cast(k as string)) AS md5, 5 AS state, 2 AS verify_method, mtime_ms AS verified_ms,
        cast(k % 3 as int) AS attempts, k + 1000000000 AS first_seen_seq
      FROM fx_inventory WHERE k % 3 < 2 AND k % 4 = 0),
l AS (SELECT {_COLUMNS} FROM fx_ledger)
SELECT coalesce(l.local_path, u.local_path) AS local_path,
  CASE WHEN u.local_path IS NULL THEN l.remote_path ELSE u.remote_path END AS remote_path,
  CASE WHEN u.local_path IS NULL THEN l.size ELSE u.size END AS size,
  CASE WHEN u.local_path IS NULL THEN l.mtime_utc ELSE u.mtime_utc END AS mtime_utc,
  CASE WHEN u.local_path IS NULL THEN l.md5 ELSE u.md5 END AS md5,
  CASE WHEN u.local_path IS NULL THEN l.state ELSE u.state END AS state,
  CASE WHEN u.local_path IS NULL THEN l.verify_method ELSE u.verify_method END AS verify_method,
  CASE WHEN u.local_path IS NULL THEN l.attempts ELSE u.attempts END AS attempts,
  CASE WHEN u.local_path IS NULL THEN l.last_error END AS last_error,
  coalesce(l.first_seen_seq, u.first_seen_seq) AS first_seen_seq,
  CASE WHEN u.local_path IS NULL THEN l.verified_ms ELSE u.verified_ms END AS verified_ms
FROM l FULL JOIN u ON lower(l.local_path) = lower(u.local_path)""")
def _(spark, d):
    return _flat(L.ledger_upsert(ledger(spark, d), _updates(spark, d)))


@query("ledger_upsert_twins", cte("fx_inventory", "fx_ledger") + f""",
u AS (SELECT * FROM (
  SELECT upper(path) AS local_path, '/new/' || name AS remote_path, mtime_ms AS mtime_utc, k + 1000000000 AS seq FROM fx_inventory
  WHERE k % 4 = 0
  UNION ALL SELECT lower(path), '/later/' || name, mtime_ms + 5, k + 2000000000 FROM fx_inventory WHERE k % 8 = 0)
  QUALIFY row_number() OVER (PARTITION BY lower(local_path) ORDER BY mtime_utc DESC, seq DESC) = 1)
SELECT coalesce(l.local_path, u.local_path) AS local_path, coalesce(u.remote_path, l.remote_path) AS remote_path,
  coalesce(u.mtime_utc, l.mtime_utc) AS mtime_utc, coalesce(l.first_seen_seq, u.seq) AS first_seen_seq
FROM fx_ledger l FULL JOIN u ON lower(l.local_path) = lower(u.local_path)""")
def _(spark, d):
    rows = view(spark, d, "fx_inventory").where("k % 4 = 0")
    rest = ["length as size", "cast(null as string) as md5", "cast(null as string) as sha256", "5 as state",
            "2 as verify_method", "timestamp_millis(mtime_ms) as verified_utc", "0 as attempts",
            "cast(null as string) as last_error", "false as is_dataset"]
    first = rows.selectExpr("upper(path) as local_path", "concat('/new/', name) as remote_path",
                            "mtime_ms as mtime_utc", "k + 1000000000 as first_seen_seq", *rest)
    later = rows.where("k % 8 = 0").selectExpr(
        "lower(path) as local_path", "concat('/later/', name) as remote_path",
        "mtime_ms + 5 as mtime_utc", "k + 2000000000 as first_seen_seq", *rest)
    return L.ledger_upsert(ledger(spark, d), first.unionByName(later)).select(
        "local_path", "remote_path", "mtime_utc", "first_seen_seq")


@query("ledger_set_state", cte("fx_ledger") + f""",
l AS (SELECT {_COLUMNS} FROM fx_ledger)
SELECT local_path, remote_path, size, mtime_utc, md5,
  CASE WHEN first_seen_seq % 4 = 1 THEN cast(first_seen_seq % 10 as int) ELSE state END AS state,
  verify_method,
  attempts + CASE WHEN first_seen_seq % 4 = 1 AND first_seen_seq % 10 = 2 THEN 1 ELSE 0 END AS attempts,
  CASE WHEN first_seen_seq % 4 <> 1 THEN last_error WHEN first_seen_seq % 3 = 1 THEN 'changed' END AS last_error,
  first_seen_seq, verified_ms FROM l""")
def _(spark, d):
    changes = table(spark, d, "orders").where("o_orderkey % 4 = 1")
    named = view(spark, d, "fx_ledger").where("k % 4 = 1").selectExpr(
        "upper(local_path) as local_path", "cast(k % 10 as int) as state",
        "case when k % 3 = 1 then 'changed' end as last_error")
    unknown = changes.selectExpr("concat('Z:/', o_orderkey) as local_path", "9 as state",
                                 "'unknown' as last_error")
    return _flat(L.ledger_set_state(ledger(spark, d), named.unionByName(unknown)))


@query("ledger_mark_verified", cte("fx_ledger") + f""",
l AS (SELECT {_COLUMNS} FROM fx_ledger)
SELECT local_path, remote_path, size, mtime_utc, md5,
  CASE WHEN first_seen_seq % 5 = 0 THEN 4 ELSE state END AS state,
  CASE WHEN first_seen_seq % 5 = 0 THEN 2 ELSE verify_method END AS verify_method, attempts,
  CASE WHEN first_seen_seq % 5 <> 0 THEN last_error END AS last_error, first_seen_seq,
  CASE WHEN first_seen_seq % 5 = 0 THEN 1700000000000 ELSE verified_ms END AS verified_ms FROM l""")
def _(spark, d):
    done = view(spark, d, "fx_ledger").where("k % 5 = 0").selectExpr(
        "lower(local_path) as local_path", "timestamp_millis(1700000000000) as verified_utc")
    return _flat(L.ledger_mark_verified(ledger(spark, d), done))


@query("ledger_fail_unknown", cte("fx_inventory", "fx_ledger") + """
SELECT path AS local_path, '' AS remote_path, coalesce(CASE WHEN k % 10 <> 0 THEN length END, 0) AS size,
  coalesce(CASE WHEN k % 10 <> 0 THEN mtime_ms END, 0) AS mtime_utc, cast(NULL as string) AS md5, 9 AS state,
  0 AS verify_method, 0 AS attempts, 'cannot be named' AS last_error, k AS first_seen_seq,
  cast(NULL as bigint) AS verified_ms
FROM fx_inventory WHERE k % 2 = 1 AND lower(path) NOT IN (SELECT lower(local_path) FROM fx_ledger)""")
def _(spark, d):
    failures = view(spark, d, "fx_inventory").where("k % 2 = 1").selectExpr(
        "path as local_path", "case when k % 10 <> 0 then length end as length",
        "case when k % 10 <> 0 then mtime_ms end as mtime_ms",
        "'cannot be named' as last_error", "k as first_seen_seq")
    return _flat(L.ledger_fail_unknown(ledger(spark, d), failures))


@query("hash_cache_upsert", cte("fx_ledger", "fx_inventory") + """
SELECT coalesce(c.local_path, u.path) AS local_path, coalesce(c.size, u.length) AS size,
  coalesce(c.mtime_utc, u.mtime_ms) AS mtime_utc,
  CASE WHEN u.path IS NULL THEN c.md5 ELSE md5('z' || cast(u.k as string)) END AS md5
FROM fx_ledger c FULL JOIN (SELECT * FROM fx_inventory WHERE k % 2 = 0) u
 ON lower(c.local_path) = lower(u.path) AND c.size = u.length AND c.mtime_utc = u.mtime_ms""")
def _(spark, d):
    cache = ledger(spark, d).select("local_path", "size", "mtime_utc", "md5", "sha256")
    updates = view(spark, d, "fx_inventory").where("k % 2 = 0").selectExpr(
        "path as local_path", "length as size", "mtime_ms as mtime_utc",
        "md5(concat('z', cast(k as string))) as md5", "cast(null as string) as sha256")
    return L.hash_cache_upsert(cache, updates).drop("sha256")


_HISTORY = """h AS (
  SELECT 'c' || conv_id || '.raw' AS local_path, turn AS seq, cast((conv_id + turn) % 10 as int) AS state,
    CASE WHEN (conv_id + turn) % 10 = 9 THEN 'failed at ' || turn END AS last_error FROM conversations)"""


@query("ledger_fold", f"""WITH {_HISTORY}
SELECT local_path, max_by(state, seq) AS state,
  max_by(coalesce(last_error, ''), seq) AS last_error,
  count(*) FILTER (state = 2) AS attempts, max(seq) AS seq FROM h GROUP BY local_path""")
def _(spark, d):
    history = table(spark, d, "conversations").selectExpr(
        "concat('c', conv_id, '.raw') as local_path", "turn as seq",
        "cast((conv_id + turn) % 10 as int) as state",
        "case when (conv_id + turn) % 10 = 9 then concat('failed at ', turn) end as last_error")
    return L.ledger_fold(history).withColumn("last_error", F.coalesce("last_error", F.lit("")))


@query("read_ledger", cte("fx_ledger") + f" SELECT {_COLUMNS} FROM fx_ledger")
def _(spark, d):
    from stowage.session import shared_dir
    from stowage.sources.ledger import read_ledger

    where = shared_dir(spark, "ledger")
    ledger(spark, d).write.parquet(where)
    return _flat(read_ledger(spark, where))


@query("count_by_state", cte("fx_ledger") + """
SELECT state, count(*) AS rows FROM fx_ledger GROUP BY state""")
def _(spark, d):
    return L.count_by_state(ledger(spark, d))


@query("rows_by_state", cte("fx_ledger") + f"""
SELECT {_COLUMNS} FROM fx_ledger WHERE state IN (2, 6, 9) ORDER BY first_seen_seq DESC LIMIT 1000""")
def _(spark, d):
    return _flat(L.rows_by_state(ledger(spark, d), [2, 6, 9], 1000))


@query("attention_top", cte("fx_ledger") + f"""
SELECT first_seen_seq, local_path, state, {Q.name_of('local_path')} AS file_name, last_error
FROM fx_ledger WHERE state IN (6, 8, 9) ORDER BY first_seen_seq DESC LIMIT 20""")
def _(spark, d):
    return A.attention_top(ledger(spark, d))


@query("audit_view", cte("fx_ledger") + f"""
SELECT {_COLUMNS} FROM fx_ledger WHERE state IN (4, 5) AND lower({Q.name_of('local_path')}) LIKE '%.raw%'""")
def _(spark, d):
    return _flat(A.audit_view(ledger(spark, d), A.VERIFIED, " .RAW "))


_SUMMARY = f"""
SELECT count(*) FILTER (state IN (4, 5)) AS on_server, count(*) FILTER (state = 4) AS hash_verified,
  count(*) FILTER (state IN (6, 8, 9)) AS attention, count(*) AS rows, count(*) FILTER (state IN (4, 5) AND lower({Q.name_of('local_path')}) LIKE '%1%') AS shown
FROM fx_ledger"""


@query("audit_summary", cte("fx_ledger") + f"""
SELECT *, format('{{:,}}', on_server) || ' on the server'
  || CASE WHEN hash_verified > 0 THEN ' (' || format('{{:,}}', hash_verified) || ' hash-verified)' ELSE '' END
  || CASE WHEN attention > 0 THEN ', ' || format('{{:,}}', attention) || ' need attention' ELSE '' END
  || ' - showing ' || format('{{:,}}', shown) AS summary FROM ({_SUMMARY})""")
def _(spark, d):
    rows = ledger(spark, d)
    return A.audit_summary(rows, A.audit_view(rows, A.VERIFIED, "1"))


_REPORT_SQL = f"""
SELECT first_seen_seq, {Q.name_of('local_path')} AS file_name, local_path, remote_path,
  {Q.words('state', AUDIT_STATE)} AS state,
  CASE verify_method WHEN 2 THEN 'Server MD5' WHEN 1 THEN 'Size only' ELSE 'Not verified' END AS verification,
  verify_method = 2 AS trustworthy, state IN (6, 8, 9) AS needs_attention,
  {Q.format_bytes('size')} AS size,
  coalesce(strftime(verified_utc, '%Y-%m-%d %H:%M'), '') AS verified_at,
  coalesce(last_error, '') AS detail
FROM fx_ledger"""


@query("audit_report", cte("fx_ledger") + _REPORT_SQL)
def _(spark, d):
    return A.audit_report(A.audit_view(ledger(spark, d)))


@query("audit_labels", cte("fx_ledger") + _REPORT_SQL)
def _(spark, d):
    return A.audit_report(ledger(spark, d))


@query("export_audit_csv", cte("fx_ledger") + f"""
SELECT local_path AS "Local path", remote_path AS "Remote path", {Q.words('state', AUDIT_STATE)} AS "State",
  CASE verify_method WHEN 2 THEN 'Server MD5' WHEN 1 THEN 'Size only' ELSE 'Not verified' END AS "Verification",
  cast(size as string) AS "Size (bytes)", coalesce(md5, '') AS "MD5",
  coalesce(strftime(verified_utc, '%Y-%m-%dT%H:%M:%S.%f') || '0+00:00', '') AS "Verified (UTC)",
  coalesce(last_error, '') AS "Detail"
FROM fx_ledger WHERE state IN (6, 8, 9)""")
def _(spark, d):
    from stowage.session import shared_dir
    from stowage.sinks.audit_csv import export_audit_csv

    where = shared_dir(spark, "audit")
    export_audit_csv(A.audit_view(ledger(spark, d), A.NEEDS_ATTENTION), where)
    back = spark.read.option("header", True).option("escape", '"').csv(where)
    return back.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in back.columns])


@query("trustworthy", cte("fx_ledger") + """
SELECT verify_method, verify_method = 2 AS trustworthy, count(*) AS rows FROM fx_ledger GROUP BY ALL""")
def _(spark, d):
    return ledger(spark, d).groupBy("verify_method").agg(F.count(F.lit(1)).alias("rows")).select(
        "verify_method", trustworthy(F.col("verify_method")).alias("trustworthy"), "rows")


@query("needs_attention", cte("fx_ledger") + """
SELECT local_path, state FROM fx_ledger WHERE state IN (9, 6, 8)""")
def _(spark, d):
    return ledger(spark, d).where(needs_attention(F.col("state"))).select("local_path", "state")


@query("render_sidecar", cte("fx_inventory") + """
SELECT folder, name || '.md5' AS name,
  md5(cast(k as string)) || '  ' || name || chr(10) || '# file      ' || name || chr(10)
  || '# bytes     ' || length || chr(10) || '# md5       ' || md5(cast(k as string)) || chr(10)
  || CASE WHEN k % 2 = 0 THEN '# sha256    ' || sha256(cast(k as string)) || chr(10) ELSE '' END
  || '# acquired  ' || strftime(make_timestamp(mtime_ms * 1000), '%Y-%m-%dT%H:%M:%SZ') || chr(10)
  || '# uploaded  2024-02-01T00:00:00Z' || chr(10) || '# by        stowage' || chr(10) AS text
FROM fx_inventory""")
def _(spark, d):
    rows = view(spark, d, "fx_inventory").selectExpr(
        "folder", "name", "length", "mtime_ms", "md5(cast(k as string)) as md5",
        "case when k % 2 = 0 then sha2(cast(k as string), 256) end as sha256",
        "timestamp'2024-02-01 00:00:00' as uploaded")
    return render_sidecar(rows, "stowage")
