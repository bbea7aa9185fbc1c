"""Progress, readiness and notices."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stowage.functions.labels import GRID_STATE
from stowage.operators import progress as P, readiness as R
from stowage.sources.notices import lost_events, source_notices
from workloads import sqltext as Q
from workloads.fixtures import QUIET_MS, cte, view
from workloads.registry import query

_PROGRESS = cte("fx_progress") + """,
latest AS (SELECT * FROM fx_progress QUALIFY row_number() OVER (PARTITION BY lower(local_path) ORDER BY seq DESC) = 1)"""
_FIELDS = "local_path, remote_path, state, phase, bytes, total, rate, verification, message, seq, ts_ms"


def progress(spark, d) -> DataFrame:
    return view(spark, d, "fx_progress")


def latest(spark, d) -> DataFrame:
    return P.latest_progress(progress(spark, d))


def observations(spark, d) -> DataFrame:
    return view(spark, d, "fx_observations")


@query("latest_progress", _PROGRESS + f" SELECT {_FIELDS} FROM latest")
def _(spark, d):
    return latest(spark, d)


@query("drain_changed", _PROGRESS + f"""
SELECT {_FIELDS} FROM latest WHERE seq > 930""")
def _(spark, d):
    return P.drain_changed(progress(spark, d), 930)


@query("clear_finished", _PROGRESS + f" SELECT {_FIELDS} FROM latest WHERE state NOT IN (4, 5)")
def _(spark, d):
    return P.clear_finished(latest(spark, d))


_TOTALS = _PROGRESS + """,
sums AS (SELECT count(*) FILTER (state = 2) AS active, count(*) FILTER (state IN (0, 1, 7)) AS queued,
  count(*) FILTER (state IN (3, 4, 5)) AS finished, count(*) FILTER (state IN (6, 8, 9)) AS needs_attention,
  cast(coalesce(sum(bytes) FILTER (state = 2), 0) as bigint) AS bytes_sent,
  cast(coalesce(sum(total) FILTER (state IN (0, 1, 2, 7)), 0) as bigint) AS bytes_total,
  round(coalesce(sum(rate) FILTER (state = 2), 0.0), 6) AS rate FROM latest),
totals AS (SELECT *,
  round(CASE WHEN bytes_total > 0 THEN least(greatest(bytes_sent / bytes_total, 0), 1) END, 6) AS fraction,
  round(CASE WHEN rate > 0 AND bytes_total > bytes_sent THEN (bytes_total - bytes_sent) / rate END, 6) AS eta_seconds
  FROM sums)"""
_TOTALS_TEXT = f"""
SELECT *, CASE WHEN active = 0 AND queued = 0 THEN
    CASE WHEN needs_attention > 0 THEN 'Idle - ' || needs_attention || ' need attention' ELSE 'Idle' END
  ELSE concat_ws(' - ', active || ' active', CASE WHEN queued > 0 THEN queued || ' queued' END,
    CASE WHEN rate > 0 THEN {Q.format_amount('rate')} || '/s' END,
    CASE WHEN eta_seconds IS NOT NULL THEN {Q.format_eta('eta_seconds', False)} || ' left' END) END AS summary
FROM totals"""


@query("transfer_totals", _TOTALS + " SELECT * FROM totals")
def _(spark, d):
    return P.transfer_totals(latest(spark, d))


@query("describe_totals", _TOTALS + _TOTALS_TEXT)
def _(spark, d):
    return P.describe_totals(P.transfer_totals(latest(spark, d)))


@query("run_summary", _PROGRESS + """,
s AS (SELECT count(*) FILTER (state IN (3, 4)) AS uploaded, count(*) FILTER (state = 5) + 7 AS skipped,
  count(*) FILTER (state = 6) AS conflicts, count(*) FILTER (state = 9) AS failed,
  cast(coalesce(sum(bytes), 0) as bigint) AS bytes_sent FROM fx_progress),
t AS (SELECT *, uploaded + skipped + conflicts + failed AS total, round(bytes_sent / 12.5, 6) AS rate FROM s)
SELECT *, CASE WHEN total = 0 THEN 'Nothing needed transferring.' ELSE concat_ws(', ',
  CASE WHEN uploaded > 0 THEN uploaded || ' uploaded' END, CASE WHEN skipped > 0 THEN skipped || ' already there' END,
  CASE WHEN conflicts > 0 THEN conflicts || ' need a decision' END, CASE WHEN failed > 0 THEN failed || ' failed' END)
  || ' in 13s.' END AS summary FROM t""")
def _(spark, d):
    return P.run_summary(progress(spark, d), 12.5, accounted=7)


@query("phase_counts", cte("fx_progress") + """
SELECT phase, count(*) AS reports FROM fx_progress WHERE state <> 2 GROUP BY phase""")
def _(spark, d):
    return P.phase_counts(progress(spark, d))


_FRACTION = "(CASE WHEN total > 0 THEN least(greatest(bytes / total, 0), 1) END)"
_ETA = "(CASE WHEN rate > 0 AND total > bytes THEN (total - bytes) / rate END)"
_REPORT = f"""
SELECT local_path, {Q.name_of('local_path')} AS file_name,
  CASE WHEN state IN (1, 2, 3) THEN 0 WHEN state IN (9, 6, 8) THEN 1 WHEN state IN (4, 5) THEN 2 ELSE 3 END AS band,
  CASE WHEN trim(phase) = '' THEN {Q.words('state', GRID_STATE)} ELSE phase END AS status,
  coalesce(message, '') AS detail, state = 2 AND total > 0 AS has_progress,
  round(coalesce({_FRACTION}, CASE WHEN state IN (3, 4, 5) THEN 1 ELSE 0 END) * 100, 6) AS percent,
  CASE WHEN state = 2 AND rate > 0 THEN {Q.format_rate('rate')} ELSE '' END AS speed,
  coalesce(CASE WHEN state = 2 THEN {Q.format_eta(_ETA, True)} END, '') AS eta,
  CASE WHEN state IN (3, 4, 5) THEN CASE verification WHEN 2 THEN 'Verified (server MD5)'
    WHEN 1 THEN 'Uploaded - size only' ELSE 'Uploaded - not verified' END ELSE '' END AS verification,
  state IN (6, 8, 9) AS needs_attention,
  CASE WHEN state = 2 AND total > 0 THEN phase || ' ' || cast(floor({_FRACTION} * 100 + 0.5) as bigint) || '% of '
      || {Q.format_amount('total')} || CASE WHEN rate > 0 THEN ' - ' || {Q.format_amount('rate')} || '/s' ELSE '' END
      || coalesce(' - ' || {Q.format_eta(_ETA, False)} || ' left', '')
    WHEN length(coalesce(message, '')) > 0 THEN phase || ' - ' || message ELSE phase END AS description"""


@query("transfer_report", Q.READINESS + "," + cte("fx_progress")[len("WITH "):] + f""",
latest AS (SELECT * FROM fx_progress QUALIFY row_number() OVER (PARTITION BY local_path ORDER BY seq DESC) = 1),
seen AS (SELECT *, lag(length) OVER (PARTITION BY path ORDER BY rn) AS previous FROM gate),
waiting AS (SELECT path AS local_path, CASE reason WHEN 2 THEN 7 ELSE 0 END AS state, 'Waiting' AS phase, 0 AS bytes,
    CASE WHEN reason = 1 THEN 0 ELSE length END AS total, 0.0 AS rate, 0 AS verification,
    CASE reason WHEN 0 THEN 'Ready to upload.'
      WHEN 2 THEN '''' || path || ''' is open in another program. This is normal while an instrument is acquiring or a copy is still running.'
      WHEN 3 THEN 'Still being written (' || format('{{:,}}', previous) || ' to ' || format('{{:,}}', length) || ' bytes since the last check).'
      ELSE 'Unchanged for ' || cast(floor(quiet_ms / 1000.0 + 0.5) as bigint) || 's; waiting for 21600s.' END AS message
  FROM seen WHERE reason <> 1 QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1),
shown AS (SELECT local_path, state, phase, bytes, total, rate, verification, message FROM latest
  UNION ALL SELECT * FROM waiting){_REPORT} FROM shown""")
def _(spark, d):
    verdicts = R.with_detail(R.readiness(observations(spark, d), QUIET_MS), QUIET_MS)
    gate = P.gate_progress(verdicts.withColumn("ts_ms", F.col("observed_ms")))
    return P.transfer_report(P.latest_progress(
        progress(spark, d).unionByName(gate)))


_GRID = cte("fx_progress") + """,
banded AS (SELECT *, CASE WHEN state IN (1, 2, 3) THEN 0 WHEN state IN (9, 6, 8) THEN 1 WHEN state IN (4, 5) THEN 2 ELSE 3 END AS band FROM fx_progress),
moved AS (SELECT *, lag(band) OVER (PARTITION BY local_path ORDER BY seq) IS DISTINCT FROM band AS entered FROM banded),
grid AS (SELECT local_path, max_by(state, seq) AS state, max(seq) FILTER (entered) AS entered_seq, max_by(band, seq) AS band
  FROM moved GROUP BY local_path)"""


@query("grid_order", _GRID + " SELECT * FROM grid")
def _(spark, d):
    return P.grid_order(progress(spark, d))


@query("trim_finished", _GRID + """
SELECT * FROM grid WHERE state NOT IN (4, 5) UNION ALL
SELECT * FROM (SELECT * FROM grid WHERE state IN (4, 5)
  QUALIFY row_number() OVER (ORDER BY entered_seq DESC) <= 80 - (SELECT count(*) FROM grid WHERE state NOT IN (4, 5)))""")
def _(spark, d):
    return P.trim_finished(P.grid_rows(progress(spark, d)), limit=80)


@query("stalled", cte("fx_progress") + """,
moved AS (SELECT *, (lag(state) OVER w IS DISTINCT FROM state) OR (lag(bytes) OVER w IS DISTINCT FROM bytes) AS moved
  FROM fx_progress WINDOW w AS (PARTITION BY local_path ORDER BY seq)),
last AS (SELECT local_path, max_by(state, seq) AS state, max_by(ts_ms, seq) FILTER (moved) AS last_change_ms
  FROM moved GROUP BY local_path)
SELECT local_path, last_change_ms, 1706659200000 - last_change_ms AS idle_ms FROM last
WHERE state = 2 AND 1706659200000 - last_change_ms > 120000""")
def _(spark, d):
    return P.stalled(progress(spark, d), 1_706_659_200_000)


@query("thin_progress", Q.kept_first("fx_progress", "local_path", "ts_ms", 259_200_000, "o.bytes >= o.total") + f"""
SELECT {_FIELDS} FROM fx_progress WHERE seq IN (SELECT seq FROM walk WHERE passes)""")
def _(spark, d):
    return R.thin_progress(progress(spark, d), 259_200_000)


@query("stability_islands", cte("fx_observations") + """,
marked AS (SELECT *, CASE WHEN probe IN (1, 5) THEN NULL ELSE length END AS sighted FROM fx_observations),
flagged AS (SELECT *, CASE WHEN lag(sighted) OVER w IS DISTINCT FROM sighted OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS opens
  FROM marked WINDOW w AS (PARTITION BY path ORDER BY observed_ms, seq)),
numbered AS (SELECT *, cast(sum(opens) OVER (PARTITION BY path ORDER BY observed_ms, seq ROWS UNBOUNDED PRECEDING) as bigint) AS run FROM flagged)
SELECT path AS path_key, run, length, min(observed_ms) AS first_ms, max(observed_ms) AS last_ms, count(*) AS looks,
  max(observed_ms) - min(observed_ms) AS quiet_ms
FROM numbered WHERE probe NOT IN (1, 5) GROUP BY path, run, length""")
def _(spark, d):
    return R.stability_islands(observations(spark, d))


@query("readiness", Q.READINESS + """
SELECT path, observed_ms, seq, CASE WHEN probe IN (1, 5) THEN 0 ELSE length END AS length,
  lag(CASE WHEN probe NOT IN (1, 5) THEN length END) OVER (PARTITION BY path ORDER BY rn) AS previous,
  reason, quiet_ms FROM gate""")
def _(spark, d):
    return R.readiness(observations(spark, d), QUIET_MS)


@query("locked_streak", Q.READINESS + """,
runs AS (SELECT *, sum(CASE WHEN reason = 2 THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY rn) AS run FROM gate),
counted AS (SELECT *, CASE WHEN reason = 2 THEN
    (count(*) FILTER (reason = 2) OVER (PARTITION BY path, run ORDER BY rn) - 1) % 2 + 1 ELSE 0 END AS streak FROM runs)
SELECT path, observed_ms, seq, reason, cast(streak as bigint) AS streak, streak > 1 AS handed_back FROM counted""")
def _(spark, d):
    return R.locked_streak(R.readiness(observations(spark, d), QUIET_MS), max_checks=1)


@query("locked_hand_back", Q.HANDED_BACK + f"""
SELECT path, observed_ms, seq, reason, locked AS streak, locked > {Q.MAX_CHECKS} AS handed_back FROM gate""")
def _(spark, d):
    """The gate that forgets a file it hands back, in batch."""
    verdicts = R.readiness(observations(spark, d), QUIET_MS, max_checks=Q.MAX_CHECKS)
    return R.locked_streak(verdicts, Q.MAX_CHECKS)


@query("stream_gate_bounded", Q.READINESS + """,
final AS (SELECT path, min(rn) FILTER (reason IN (0, 1, 5)) AS done, max(rn) AS last FROM gate
  WHERE observed_ms <= 1705363200000 GROUP BY path)
SELECT g.path, CASE WHEN f.done IS NULL THEN 'waiting' WHEN g.reason = 0 THEN 'released' ELSE 'abandoned' END AS outcome,
  g.reason, g.observed_ms FROM final f JOIN gate g ON g.path = f.path AND g.rn = coalesce(f.done, f.last)""")
def _(spark, d):
    return R.gate_bounded(observations(spark, d), 1_705_363_200_000, QUIET_MS)


@query("source_notices", cte("fx_notices") + """
SELECT path, kind, ts_ms, seq FROM fx_notices WHERE kind IN ('created', 'changed', 'renamed') AND NOT is_dir
 AND path LIKE '%.raw'""")
def _(spark, d):
    return source_notices(view(spark, d, "fx_notices"), [".raw"]).drop("is_dir")


@query("lost_events", cte("fx_notices") + """
SELECT kind, count(*) AS notices FROM fx_notices WHERE kind = 'overflow' GROUP BY kind""")
def _(spark, d):
    return lost_events(view(spark, d, "fx_notices")).groupBy("kind").agg(
        F.count(F.lit(1)).alias("notices"))


@query("suppress_repeats", Q.kept_first("fx_notices", "path", "ts_ms", QUIET_MS) + """
SELECT path, kind, is_dir, ts_ms, seq FROM fx_notices WHERE seq IN (SELECT seq FROM walk WHERE passes)""")
def _(spark, d):
    return R.suppress_repeats(view(spark, d, "fx_notices"), QUIET_MS)
