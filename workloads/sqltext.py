"""Pieces of SQL that several twins share."""

from __future__ import annotations

from workloads.fixtures import DUCK, ROOT, cte

NAME_OF = r"regexp_extract({0}, '([^/\\]*)$', 1)"
KEPT = "name NOT LIKE '~%' AND name NOT LIKE '.%'"
DEST = f"CASE WHEN name NOT LIKE '%;%' THEN '{ROOT}' || folder || '/' || {DUCK['enc']('name')} END"
LOCAL_MD5 = "CASE WHEN k % 13 = 0 THEN md5('y' || cast(k as string)) ELSE md5(cast(k as string)) END"


def name_of(column: str) -> str:
    return NAME_OF.format(column)


def tenths(x: str) -> str:
    return f"(cast(({x}) // 10 as string) || '.' || cast(({x}) % 10 as string))"


def format_bytes(x: str) -> str:
    arms = [f"WHEN {x} < 1024 THEN cast({x} as string) || ' B'"]
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), start=1):
        size = 1024 ** power
        text = tenths(f"({x} * 20 + {size}) // {2 * size}") + f" || ' {unit}'"
        arms.append(f"WHEN {x} < {size * 1024} THEN {text}" if power < 4 else f"ELSE {text}")
    return f"(CASE {' '.join(arms)} END)"


def _scaled(x: str, units: tuple[str, ...], first: str) -> str:
    arms = [f"WHEN {x} < 1024 THEN {first}"]
    for power, unit in enumerate(units, start=1):
        size = float(1024 ** power)
        text = tenths(f"cast(floor({x} / {size} * 10 + 0.5) as bigint)") + f" || ' {unit}'"
        arms.append(f"WHEN {x} < {size * 1024} THEN {text}" if power < len(units) else f"ELSE {text}")
    return f"(CASE {' '.join(arms)} END)"


def format_amount(x: str) -> str:
    return _scaled(x, ("KB", "MB", "GB", "TB"), f"cast(cast(floor({x} + 0.5) as bigint) as string) || ' B'")


def format_rate(x: str) -> str:
    first = tenths(f"cast(floor({x} * 10 + 0.5) as bigint)") + " || ' B'"
    return f"({_scaled(x, ('KB', 'MB', 'GB'), first)} || '/s')"


def format_eta(x: str, grid: bool) -> str:
    whole = f"cast(floor({x}) as bigint)"
    seconds = f" || ' ' || cast({whole} % 60 as string) || 's'" if grid else ""
    return (f"(CASE WHEN {x} >= 3600 THEN cast({whole} // 3600 as string) || 'h ' ||"
            f" cast({whole} // 60 % 60 as string) || 'm'"
            f" WHEN {x} >= 60 THEN cast({whole} // 60 as string) || 'm'{seconds}"
            f" WHEN {x} IS NOT NULL THEN cast(greatest({whole}, 1) as string) || 's' END)")


def words(x: str, mapping: dict[int, str], default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {code} THEN '{word}'" for code, word in mapping.items())
    return f"(CASE {x} {arms} ELSE {default} END)"


SWEPT = (
    cte("fx_inventory", "fx_ledger") + f""",
joined AS (
  SELECT i.path, i.length, i.mtime_ms, {DEST.replace('name', 'i.name').replace('folder', 'i.folder')} AS destination,
         l.local_path, l.remote_path, l.size, l.mtime_utc, l.state, l.verify_method, l.attempts, l.md5
  FROM fx_inventory i LEFT JOIN fx_ledger l ON lower(i.path) = lower(l.local_path)
  WHERE i.name NOT LIKE '~%' AND i.name NOT LIKE '.%'),
swept AS (
  SELECT path, length, mtime_ms, destination,
    CASE WHEN local_path IS NULL OR destination IS NULL THEN false
         WHEN state IN (4, 5) AND verify_method = 2 AND size = length AND mtime_utc = mtime_ms
              AND remote_path = destination THEN true
         WHEN NOT (size = length AND mtime_utc = mtime_ms) THEN false
         WHEN state = 6 THEN true
         WHEN state = 9 THEN attempts >= 5
         ELSE false END AS accounted
  FROM joined)""")


def decided(policy: str = "0") -> str:
    """The ladder in plain SQL; ``policy`` is an expression over a file's columns."""
    action = f"CASE {policy} WHEN 1 THEN 'Skip' WHEN 2 THEN 'Upload' ELSE 'Conflict' END"
    suffix = (f"CASE {policy} WHEN 1 THEN ' Skipped by policy.' WHEN 2 THEN ' Overwriting by policy.'"
              " WHEN 3 THEN ' A new name is needed.' ELSE '' END")
    # The sentences are those that the ladder shows.
    return cte("fx_inventory", "fx_ledger", "fx_remote") + f""",
files AS (
  SELECT k, path, length, mtime_ms, name, '{ROOT}' || folder || '/' AS folder, {DEST} AS destination,
         {LOCAL_MD5} AS local_md5
  FROM fx_inventory WHERE {KEPT} AND name NOT LIKE '%;%'),
contents AS (
  SELECT size, md5, min_by(local_path, first_seen_seq) AS local_path FROM fx_ledger
  WHERE state IN (4, 5) AND verify_method = 2 AND md5 IS NOT NULL GROUP BY size, md5),
looked AS (
  SELECT f.*, l.md5 AS l_md5, r.is_collection, r.length AS r_length, r.md5 AS r_md5,
    coalesce(l.state IN (4, 5) AND l.verify_method = 2 AND l.size = f.length
             AND l.mtime_utc = f.mtime_ms AND l.remote_path = f.destination, false) AS settled,
    coalesce(l.remote_path = f.destination AND l.md5 = r.md5, false) AS ours, r.k AS r_k
  FROM files f LEFT JOIN fx_ledger l ON lower(f.path) = lower(l.local_path)
  LEFT JOIN fx_remote r ON r.folder = f.folder AND r.name = f.name),
stepped AS (
  SELECT *, CASE WHEN settled THEN 'ledger' WHEN r_k IS NULL THEN 'absent'
    WHEN is_collection THEN 'folder' WHEN r_length <> length AND ours THEN 'size_ours'
    WHEN r_length <> length THEN 'size' WHEN r_md5 IS NULL THEN 'no_hash'
    WHEN local_md5 = r_md5 THEN 'same' WHEN ours THEN 'hash_ours' ELSE 'hash' END AS step
  FROM looked),
decided AS (
  SELECT s.path, s.length, s.mtime_ms, s.destination,
    CASE WHEN step IN ('ledger', 'same') THEN 'Skip'
         WHEN step IN ('absent', 'size_ours', 'hash_ours') THEN 'Upload'
         WHEN step = 'folder' THEN 'Conflict' ELSE {action} END AS action,
    CASE WHEN step = 'ledger' THEN 0 WHEN step IN ('same', 'hash_ours', 'hash') THEN 2 ELSE 1 END AS tier,
    CASE step
      WHEN 'ledger' THEN 'Already uploaded and verified; unchanged since.'
      WHEN 'absent' THEN 'Not present on the server.'
      WHEN 'folder' THEN 'A folder named ''' || s.name || ''' already occupies the destination.'
      WHEN 'size_ours' THEN 'The local file has changed since it was uploaded.'
      WHEN 'hash_ours' THEN 'The local file has changed since it was uploaded.'
      WHEN 'size' THEN 'A different file is already there (' || format('{{:,}}', r_length)
           || ' bytes on the server, ' || format('{{:,}}', s.length) || ' locally).' || {suffix}
      WHEN 'no_hash' THEN 'A file of the same size is already there, but the server did not report a hash for it, so it cannot be confirmed identical.' || {suffix}
      WHEN 'same' THEN 'An identical copy is already on the server.'
      ELSE 'A file with the same name and size but different content is already on the server.' || {suffix} END AS reason,
    CASE WHEN step IN ('same', 'hash_ours', 'hash') THEN local_md5 END AS md5,
    CASE WHEN step = 'ledger' THEN l_md5 WHEN step = 'same' THEN r_md5
         WHEN step = 'hash' AND {policy} NOT IN (1, 2) THEN r_md5 END AS remote_hash,
    CASE WHEN step = 'hash' THEN c.local_path END AS already_uploaded_as
  FROM stepped s LEFT JOIN contents c ON c.size = s.length AND c.md5 = s.local_md5)"""


DECISION_COLUMNS = """path, length, mtime_ms, destination, action, tier, reason, md5,
  cast(NULL as string) AS sha256, remote_hash, already_uploaded_as,
  CASE WHEN action = 'Skip' AND remote_hash IS NOT NULL THEN 2 ELSE 0 END AS implied_verification"""


READINESS = cte("fx_observations", recursive=True) + f""",
looks AS (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY observed_ms, seq) AS rn
  FROM fx_observations),
gate AS (
  SELECT path, rn, observed_ms, seq, length, probe,
    CASE WHEN probe IN (1, 5) THEN probe ELSE 4 END AS reason,
    CASE WHEN probe NOT IN (1, 5) THEN 0 END AS quiet_ms,
    CASE WHEN probe NOT IN (1, 5) THEN length END AS watched,
    CASE WHEN probe NOT IN (1, 5) THEN observed_ms END AS since
  FROM looks WHERE rn = 1
  UNION ALL
  SELECT o.path, o.rn, o.observed_ms, o.seq, o.length, o.probe,
    CASE WHEN o.probe IN (1, 5) THEN o.probe WHEN g.since IS NULL THEN 4
         WHEN g.watched <> o.length THEN 3 WHEN o.probe = 2 THEN 2
         WHEN o.observed_ms - g.since < 21600000 THEN 4 ELSE 0 END,
    CASE WHEN o.probe IN (1, 5) THEN NULL WHEN g.since IS NULL OR g.watched <> o.length THEN 0
         ELSE o.observed_ms - g.since END,
    CASE WHEN o.probe IN (1, 5) THEN NULL WHEN g.since IS NULL OR g.watched <> o.length THEN o.length
         WHEN o.probe <> 2 AND o.observed_ms - g.since >= 21600000 THEN NULL ELSE g.watched END,
    CASE WHEN o.probe IN (1, 5) THEN NULL WHEN g.since IS NULL OR g.watched <> o.length THEN o.observed_ms
         WHEN o.probe <> 2 AND o.observed_ms - g.since >= 21600000 THEN NULL ELSE g.since END
  FROM gate g JOIN looks o ON o.path = g.path AND o.rn = g.rn + 1)"""


def kept_first(view: str, key: str, time: str, wait_ms: int, forced: str = "false") -> str:
    """Rows that pass when each must lie ``wait_ms`` after the last that passed."""
    return cte(view, recursive=True) + f""",
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {time}, seq) AS rn FROM {view}),
walk AS (
  SELECT {key}, rn, seq, {time} AS last, true AS passes FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.{key}, o.rn, o.seq,
    CASE WHEN {forced} OR o.{time} - w.last >= {wait_ms} THEN o.{time} ELSE w.last END,
    {forced} OR o.{time} - w.last >= {wait_ms}
  FROM walk w JOIN ordered o ON o.{key} = w.{key} AND o.rn = w.rn + 1)"""

#: The same for a gate that hands a file back after more than so many locked looks in a row, and then forgets it.
MAX_CHECKS = 1
_SAME = "g.since IS NOT NULL AND g.watched = o.length AND o.probe NOT IN (1, 5)"
_LOCKED = f"CASE WHEN {_SAME} AND o.probe = 2 THEN g.locked + 1 ELSE 0 END"
_FORGOTTEN = f"o.probe IN (1, 5) OR ({_SAME} AND o.probe <> 2 AND o.observed_ms - g.since >= 21600000) OR {_LOCKED} > {MAX_CHECKS}"
HANDED_BACK = cte("fx_observations", recursive=True) + f""",
looks AS (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY observed_ms, seq) AS rn
  FROM fx_observations),
gate AS (
  SELECT path, rn, observed_ms, seq, length, probe, CASE WHEN probe IN (1, 5) THEN probe ELSE 4 END AS reason,
    CASE WHEN probe NOT IN (1, 5) THEN 0 END AS quiet_ms, CASE WHEN probe NOT IN (1, 5) THEN length END AS watched,
    CASE WHEN probe NOT IN (1, 5) THEN observed_ms END AS since, cast(0 as bigint) AS locked
  FROM looks WHERE rn = 1
  UNION ALL
  SELECT o.path, o.rn, o.observed_ms, o.seq, o.length, o.probe,
    CASE WHEN o.probe IN (1, 5) THEN o.probe WHEN g.since IS NULL THEN 4 WHEN NOT ({_SAME}) THEN 3 WHEN o.probe = 2 THEN 2
         WHEN o.observed_ms - g.since < 21600000 THEN 4 ELSE 0 END,
    CASE WHEN o.probe IN (1, 5) THEN NULL WHEN {_SAME} THEN o.observed_ms - g.since ELSE 0 END,
    CASE WHEN {_FORGOTTEN} THEN NULL ELSE o.length END,
    CASE WHEN {_FORGOTTEN} THEN NULL WHEN {_SAME} THEN g.since ELSE o.observed_ms END, {_LOCKED}
  FROM gate g JOIN looks o ON o.path = g.path AND o.rn = g.rn + 1)"""
