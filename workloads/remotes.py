"""Remote listings, manifests, snapshots and verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stowage.functions.rules import allows_method, atomic_publish, is_sidecar
from stowage.operators import remote as R
from stowage.operators.audit import classify_failure, log_tail, redacted_logs
from stowage.sources import listings, manifests
from workloads import sqltext as Q
from workloads.fixtures import ROOT, cte, remote, table, view
from workloads.registry import query

# The sentences in the SQL below are those that the operators show.
_VERBS = ("CASE k % 3 WHEN 0 THEN 'OPTIONS, get,PUT , MOVE' WHEN 1 THEN 'OPTIONS, GET' ELSE '' END")


def documents(spark, d) -> DataFrame:
    """One listing document per order: the entry, its sidecar and a nameless entry.

    Field names vary in case and numbers come as text in some of them; every 50th document is a
    login page instead.
    """
    rows = remote(spark, d)
    entry = rows.selectExpr(
        "k", "folder", "name", "is_collection", "length", "ms",
        f"{_VERBS.replace('CASE k % 3', 'case k % 3')} as options",
        "case k % 4 when 0 then date_format(timestamp_millis(ms), \"yyyy-MM-dd'T'HH:mm:ss\")"
        " when 1 then concat(date_format(timestamp_millis(ms), \"yyyy-MM-dd'T'HH:mm:ss\"), '-00:00')"
        " when 2 then date_format(timestamp_millis(ms), \"EEE, dd MMM yyyy HH:mm:ss 'GMT'\")"
        " else date_format(timestamp_millis(ms), 'HH:mm') end as stamp")
    main = F.struct(
        F.col("name").alias("text"), F.col("options"),
        (F.col("k") % 2 == 0).alias("canUpload"), F.lit(True).alias("canRead"),
        F.when(F.col("k") % 4 == 0, F.col("is_collection")).alias("collection"),
        F.when(F.col("k") % 4 != 0, ~F.col("is_collection")).alias("leaf"),
        F.when(F.col("k") % 3 == 0, F.col("length").cast("string")).alias("contentlength"),
        F.when(F.col("k") % 3 == 1, F.col("length").cast("string")).alias("size"),
        F.when(F.col("k") % 5 != 0, F.col("stamp")).alias("lastmodified"),
        F.lit("2020-01-01T00:00:00-00:00").alias("creationdate"),
        F.concat(F.lit("u"), (F.col("k") % 7).cast("string")).alias("createdby"))
    body = F.to_json(F.struct(F.array(main).alias("files")))
    other = F.concat(F.lit(',{"TEXT":"'), F.col("name"), F.lit('.md5","CanRead":true,"Size":'),
                     (F.col("k") % 90).cast("string"), F.lit('},{"text":""},]}'))
    listing = F.concat(F.regexp_replace(body, r"\]\}$", ""), other)
    return entry.select("folder", F.when(F.col("k") % 50 == 0, F.lit("<html>Sign in</html>"))
                        .otherwise(listing).alias("value"))


def entries(spark, d) -> DataFrame:
    return listings.listing_entries(listings.parse_listings(documents(spark, d)))


_ENTRIES = cte("fx_remote") + f""",
entries AS (
  SELECT k, folder, name, is_collection, CASE WHEN k % 3 = 2 THEN 0 ELSE length END AS length,
    CASE WHEN k % 5 = 0 OR k % 4 = 3 THEN 1577836800000 ELSE ms // 1000 * 1000 END AS modified_ms,
    'u' || (k % 7) AS created_by, true AS can_read, k % 2 = 0 AS can_upload,
    CASE k % 3 WHEN 0 THEN 'OPTIONS, GET, PUT, MOVE' WHEN 1 THEN 'OPTIONS, GET' ELSE '' END AS methods
  FROM fx_remote WHERE k % 50 <> 0
  UNION ALL
  SELECT k, folder, name || '.md5', false, k % 90, NULL, NULL, true, false, '' FROM fx_remote WHERE k % 50 <> 0)"""


@query("read_listing_json", _ENTRIES + """
SELECT folder, name, is_collection, length, modified_ms, created_by, can_read, can_upload, methods,
  cast(NULL as string) AS problem FROM entries
UNION ALL
SELECT folder, NULL, NULL, NULL, NULL, NULL, false, false, '',
  'The server did not return a JSON directory listing. This usually means the request was not authenticated.'
FROM fx_remote WHERE k % 50 = 0""")
def _(spark, d):
    p = F.col("permissions")
    return listings.parse_listings(documents(spark, d)).select(
        "folder", "name", "is_collection", "length",
        F.unix_millis("last_modified").alias("modified_ms"), "created_by",
        p.can_read.alias("can_read"), p.can_upload.alias("can_upload"),
        F.array_join(p.allowed_methods, ", ").alias("methods"), "problem")


@query("remote_catalog", _ENTRIES + """
SELECT folder, name, folder || replace(url_encode(name), '%40', '@') || CASE WHEN is_collection THEN '/' ELSE '' END AS path,
  is_collection, length, modified_ms, created_by, can_read, can_upload, methods,
  methods LIKE '%PUT%' AS accepts_put, can_upload AND methods LIKE '%MOVE%' AS atomic_publish,
  name LIKE '%.md5' AS is_sidecar FROM entries""")
def _(spark, d):
    return R.remote_catalog(entries(spark, d)).select(
        "folder", "name", "path", "is_collection", "length",
        F.unix_millis("last_modified").alias("modified_ms"), "created_by", "can_read",
        "can_upload", "methods", "accepts_put", "atomic_publish", "is_sidecar")


@query("allows_method", _ENTRIES + """
SELECT folder, name, methods LIKE '%MOVE%' AS may_move, methods LIKE '%PUT%' AS may_put FROM entries""")
def _(spark, d):
    verbs = F.col("permissions.allowed_methods")
    return entries(spark, d).select("folder", "name", allows_method(verbs, "move").alias("may_move"),
                                    allows_method(verbs, "PUT").alias("may_put"))


@query("atomic_publish", _ENTRIES + """
SELECT can_upload AND methods LIKE '%MOVE%' AS atomic, count(*) AS entries FROM entries GROUP BY ALL""")
def _(spark, d):
    return entries(spark, d).groupBy(atomic_publish(F.col("permissions")).alias("atomic")).agg(
        F.count(F.lit(1)).alias("entries"))


@query("writable_folders", _ENTRIES + """
SELECT folder, name, can_upload, CASE WHEN can_upload THEN 'You can upload to this folder.'
  ELSE 'Read-only. A server administrator would need to grant write access.' END AS hint
FROM entries WHERE is_collection AND name NOT LIKE '.%'""")
def _(spark, d):
    return R.writable_folders(entries(spark, d))


@query("is_sidecar", _ENTRIES + """
SELECT name LIKE '%.md5' AS sidecar, count(*) AS entries FROM entries GROUP BY ALL""")
def _(spark, d):
    rows = entries(spark, d).withColumn("name", F.when(F.length("name") % 2 == 0, F.upper("name"))
                                        .otherwise(F.col("name")))
    return rows.groupBy(is_sidecar(F.col("name")).alias("sidecar")).agg(
        F.count(F.lit(1)).alias("entries"))


@query("listing_order", _ENTRIES + f"""
SELECT folder, CASE WHEN is_collection THEN 'DIR' ELSE 'FILE' END AS kind,
  CASE WHEN is_collection THEN '' ELSE {Q.format_bytes('length')} END AS size, name FROM entries""")
def _(spark, d):
    return R.listing_order(entries(spark, d))


@query("destination_writable", _ENTRIES + f"""
SELECT f.folder || f.name AS destination, e.k IS NOT NULL AS found, coalesce(e.can_upload, true) AS writable,
  CASE WHEN e.k IS NULL THEN f.folder || f.name || ' does not exist yet; it will be created on the first upload.'
       WHEN e.can_upload THEN 'You can upload to ' || f.folder || f.name || '.'
       ELSE f.folder || f.name || ' is read-only for this account. A server administrator needs to grant write access.' END AS detail
FROM fx_remote f LEFT JOIN entries e ON e.folder = f.folder AND e.name = f.name AND e.is_collection""")
def _(spark, d):
    asked = remote(spark, d).selectExpr(
        "folder || name as destination", "folder as parent", "name")
    return R.destination_writable(asked, entries(spark, d))


def hashes(spark, d) -> DataFrame:
    return remote(spark, d).where("md5 is not null").select("folder", "name", "md5")


@query("hash_listing", cte("fx_remote") + """
SELECT folder, name, md5 || '  ' || name AS line FROM fx_remote WHERE md5 IS NOT NULL""")
def _(spark, d):
    return R.hash_listing(hashes(spark, d))


@query("folder_hash_count", cte("fx_remote") + """
SELECT folder, count(*) FILTER (NOT is_collection) AS files, count(md5) AS hashes FROM fx_remote
GROUP BY folder""")
def _(spark, d):
    return R.folder_hash_count(remote(spark, d), hashes(spark, d))


def _expected(spark, d) -> DataFrame:
    return view(spark, d, "fx_inventory").selectExpr(
        f"'{ROOT}' || folder || '/' as folder", "name", "md5(cast(k as string)) as md5")


_EXPECTED = f"""
e AS (SELECT '{ROOT}' || folder || '/' AS folder, name, md5(cast(k as string)) AS md5 FROM fx_inventory)"""


@query("manifest_diff", cte("fx_inventory", "fx_remote") + f""",{_EXPECTED},
a AS (SELECT folder, name, md5 FROM fx_remote WHERE md5 IS NOT NULL)
SELECT coalesce(e.folder, a.folder) AS folder, coalesce(e.name, a.name) AS name,
  e.md5 AS expected_md5, a.md5 AS actual_md5,
  CASE WHEN a.name IS NULL THEN 'missing' WHEN e.name IS NULL THEN 'extra'
       WHEN a.md5 = e.md5 THEN 'match' ELSE 'changed' END AS status
FROM e FULL JOIN a ON e.folder = a.folder AND e.name = a.name""")
def _(spark, d):
    return R.manifest_diff(_expected(spark, d), hashes(spark, d))


@query("name_except", cte("fx_inventory", "fx_remote") + f""",{_EXPECTED}
SELECT folder, name FROM e EXCEPT ALL SELECT folder, name FROM fx_remote""")
def _(spark, d):
    return R.name_except(_expected(spark, d), remote(spark, d))


@query("verify_outcomes", cte("fx_inventory", "fx_remote") + f"""
SELECT i.path, CASE WHEN r.md5 = md5(cast(i.k as string)) THEN 4 ELSE 9 END AS state,
  CASE WHEN r.md5 = md5(cast(i.k as string)) THEN 2 ELSE 0 END AS verify_method,
  CASE WHEN r.md5 IS NULL THEN 'The server did not report a hash for the uploaded file, so it could not be verified.'
       WHEN r.md5 <> md5(cast(i.k as string)) THEN 'The server stored different content than was sent (server '
         || r.md5 || ', local ' || md5(cast(i.k as string)) || ').' END AS last_error,
  md5(cast(i.k as string)) AS md5, r.md5 AS server_md5
FROM fx_inventory i LEFT JOIN (SELECT * FROM fx_remote WHERE md5 IS NOT NULL) r
  ON r.folder = '{ROOT}' || i.folder || '/' AND r.name = i.name""")
def _(spark, d):
    sent = view(spark, d, "fx_inventory").selectExpr(
        "path", f"'{ROOT}' || folder || '/' as folder", "name", "md5(cast(k as string)) as md5")
    return R.verify_outcomes(sent, hashes(spark, d))


def _folders(spark, d) -> DataFrame:
    return remote(spark, d).groupBy("folder").agg(F.max("ms").alias("taken_ms"))


_FOLDERS = """
folders AS (SELECT folder, max(ms) AS taken_ms FROM fx_remote GROUP BY folder)"""


@query("snapshot_overlay", cte("fx_inventory", "fx_remote") + f""",{_FOLDERS},
v AS (SELECT '{ROOT}' || folder || '/' AS folder, name, length + 1 AS length, md5('v' || k) AS md5
      FROM fx_inventory WHERE k % 3 = 0),
s AS (SELECT folder, name, is_collection, length, md5 FROM fx_remote WHERE folder IN (SELECT folder FROM folders)),
o AS (SELECT * FROM v WHERE folder IN (SELECT folder FROM folders))
SELECT coalesce(o.folder, s.folder) AS folder, coalesce(o.name, s.name) AS name,
  CASE WHEN o.name IS NOT NULL THEN false ELSE s.is_collection END AS is_collection,
  CASE WHEN o.name IS NOT NULL THEN o.length ELSE s.length END AS length,
  CASE WHEN o.name IS NOT NULL THEN o.md5 ELSE s.md5 END AS md5, f.taken_ms
FROM s FULL JOIN o ON s.folder = o.folder AND s.name = o.name
JOIN folders f ON f.folder = coalesce(o.folder, s.folder)""")
def _(spark, d):
    folders = _folders(spark, d)
    cached = remote(spark, d).join(folders.select("folder"), "folder", "left_semi")
    verified = view(spark, d, "fx_inventory").where("k % 3 = 0").selectExpr(
        f"'{ROOT}' || folder || '/' as folder", "name", "length + 1 as length",
        "md5('v' || k) as md5")
    return R.snapshot_overlay(cached, folders, verified)


@query("snapshot_fresh", cte("fx_inventory", "fx_remote") + f""",{_FOLDERS},
n AS (SELECT DISTINCT '{ROOT}' || folder || '/' AS folder FROM fx_inventory),
clock AS (SELECT quantile_disc(taken_ms, 0.5) + 300000 AS now_ms FROM folders)
SELECT n.folder, f.taken_ms, CASE WHEN f.folder IS NULL THEN 'refresh' ELSE 'fresh' END AS status
FROM n LEFT JOIN (SELECT folder, taken_ms FROM folders, clock WHERE now_ms - taken_ms <= 300000) f
  ON f.folder = n.folder""")
def _(spark, d):
    folders = _folders(spark, d)
    now = folders.agg(F.expr("percentile_disc(0.5) within group (order by taken_ms)")).scalar()
    needed = view(spark, d, "fx_inventory").selectExpr(f"'{ROOT}' || folder || '/' as folder")
    return R.snapshot_fresh(needed, folders, now + 300_000)


@query("fetched_folders", cte("fx_inventory", "fx_remote") + f"""
SELECT n.folder, coalesce(r.entries, 0) AS entries, 1700000000000 AS taken_ms
FROM (SELECT DISTINCT '{ROOT}' || folder || '/' AS folder FROM fx_inventory) n
LEFT JOIN (SELECT folder, count(*) AS entries FROM fx_remote GROUP BY folder) r
  ON r.folder = n.folder""")
def _(spark, d):
    needed = view(spark, d, "fx_inventory").selectExpr(f"'{ROOT}' || folder || '/' as folder")
    return R.fetched_folders(needed, remote(spark, d), 1_700_000_000_000)


@query("map_drives", cte("fx_inventory") + """,
p AS (SELECT path, CASE k % 4 WHEN 0 THEN path
        WHEN 1 THEN chr(cast(112 + k % 7 as int)) || ':' || chr(92) || replace(path[4:], '/', chr(92))
        WHEN 2 THEN 'Z:/' || path[4:] ELSE chr(92) || chr(92) || 'srv/x' END AS local FROM fx_inventory)
SELECT local AS local_path, CASE WHEN r_name IS NOT NULL
    THEN chr(92) || chr(92) || 'nas' || chr(92) || r_name || chr(92) || local[4:] ELSE local END AS mapped_path
FROM p LEFT JOIN region ON local[1:2] = chr(cast(112 + r_regionkey as int)) || ':'""")
def _(spark, d):
    local = F.expr(r"""case k % 4 when 0 then path
                       when 1 then concat(chr(112 + k % 7), ':', chr(92), replace(substr(path, 4), '/', chr(92)))
                       when 2 then concat('Z:/', substr(path, 4)) else concat(chr(92), chr(92), 'srv/x') end""")
    # One share for each region; two of the drive letters in use are mapped to none.
    rows = view(spark, d, "fx_inventory").withColumn("local_path", local)
    mapping = table(spark, d, "region").selectExpr(
        "concat(chr(80 + r_regionkey), ':') as drive",
        r"concat(chr(92), chr(92), 'nas', chr(92), r_name, chr(92)) as share")
    return R.map_drives(rows.select("local_path"), mapping, "local_path")


def _manifests(spark, d) -> DataFrame:
    """One manifest per document: a line per line of its text, named by length so that names
    repeat; some with CRLF, blank lines and upper-case hashes."""
    docs = table(spark, d, "documents")
    lines = F.transform(F.split("text", "\n"), lambda s, i: F.concat(
        F.when(i % 3 == 0, F.upper(F.md5(s))).otherwise(F.md5(s)),
        F.when(i % 2 == 0, " *").otherwise("  "), F.lit("line "),
        F.length(s).cast("string"), F.when(i % 4 == 0, "\r").otherwise("")))
    return docs.select(F.col("doc_id").cast("string").alias("folder"),
                       F.concat(F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n\n")).alias("value"))


_LINES = """WITH l AS (
  SELECT cast(doc_id as string) AS folder, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)"""


@query("read_md5_manifest", _LINES + """
SELECT folder, 'line ' || length(line) AS name, max_by(md5(line), pos) AS md5 FROM l GROUP BY ALL""")
def _(spark, d):
    return manifests.parse_md5_manifest(_manifests(spark, d))


@query("read_md5_single", _LINES + " SELECT folder, md5(line) AS md5 FROM l WHERE pos = 1")
def _(spark, d):
    return manifests.parse_md5_single(_manifests(spark, d))


@query("manifest_errors", _LINES + """
SELECT folder, pos - 1 AS line_no, line, 'Unexpected line in an md5sum response: '''
  || CASE WHEN length(line) <= 80 THEN line ELSE line[1:80] || '...' END || '''.' AS problem
FROM (SELECT folder, pos, CASE WHEN line LIKE '%' || chr(13) THEN line[1:-2] ELSE line END AS line FROM l)
WHERE line <> ''""")
def _(spark, d):
    # Plain prose holds no manifest line at all.
    return manifests.manifest_errors(table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("folder"), F.col("text").alias("value")))


_STATUS = "CASE event_id % 10 WHEN 0 THEN 401 WHEN 1 THEN 403 WHEN 2 THEN 404 WHEN 3 THEN 409 WHEN 4 THEN 413 WHEN 5 THEN 507 WHEN 6 THEN 503 WHEN 7 THEN 429 WHEN 8 THEN 418 ELSE 500 END"


@query("classify_failure", f"""
WITH f AS (SELECT event_id, {_STATUS} AS status, CASE WHEN event_id % 2 = 0 THEN 'PUT' ELSE 'MKCOL' END AS method,
             'f' || user_id || '.raw' AS name, event_type AS phrase FROM events)
SELECT *, status IN (408, 429, 500, 502, 503, 504) AS transient,
  CASE status WHEN 401 THEN 'The server rejected the credentials. Check the API key or password on the Remote Settings tab.'
    WHEN 403 THEN 'No permission to ' || lower(method) || ' ''' || name || '''. A server administrator needs to grant write access to this folder.'
    WHEN 404 THEN '''' || name || ''' was not found on the server.'
    WHEN 409 THEN 'The parent folder of ''' || name || ''' does not exist on the server.'
    WHEN 413 THEN 'The server refused ''' || name || ''' as too large.'
    WHEN 507 THEN 'The server is out of storage space.'
    WHEN 418 THEN 'The server returned 418 ' || phrase || ' for ' || method || ' ''' || name || '''.'
    ELSE 'The server is temporarily unavailable (' || status || '). This will be retried.' END AS message FROM f""")
def _(spark, d):
    rows = table(spark, d, "events").selectExpr(
        "event_id", f"{_STATUS} as status", "case when event_id % 2 = 0 then 'PUT' else 'MKCOL' end as method",
        "concat('f', user_id, '.raw') as name", "event_type as phrase")
    return classify_failure(rows)


@query("redact_props", """
WITH p AS (SELECT event_id, unnest(['Path', 'ApiKey', 'RequestAuthorizationHeader', event_type || 'Token', 'k']) AS name,
  unnest(['f' || user_id, 'abc' || event_id, 'Bearer x', 'password', json_extract_string(props, '$.k')]) AS value FROM events)
SELECT event_id, name, CASE WHEN regexp_matches(name, '(?i)apikey|authorization|token') THEN '[redacted]' ELSE value END AS value FROM p""")
def _(spark, d):
    lines = table(spark, d, "events").select("event_id", F.create_map(
        F.lit("Path"), F.concat(F.lit("f"), F.col("user_id").cast("string")),
        F.lit("ApiKey"), F.concat(F.lit("abc"), F.col("event_id").cast("string")),
        F.lit("RequestAuthorizationHeader"), F.lit("Bearer x"),
        F.concat("event_type", F.lit("Token")), F.lit("password"),
        F.lit("k"), F.get_json_object("props", "$.k")).alias("props"))
    return redacted_logs(lines).select("event_id", F.explode("props").alias("name", "value"))


@query("log_tail", """
SELECT event_id AS seq, epoch_us(ts) AS ts, event_type AS level, 'user ' || user_id AS message
FROM events ORDER BY ts DESC, event_id DESC LIMIT 2000""")
def _(spark, d):
    lines = table(spark, d, "events").selectExpr(
        "event_id as seq", "unix_micros(cast(ts as timestamp)) as ts", "event_type as level",
        "concat('user ', user_id) as message")
    return log_tail(lines)
