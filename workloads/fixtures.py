"""Inventory, ledger, listings, looks and progress derived from the given tables.

Each view exists twice: as a DataFrame and as the text of a common table expression. The
expressions are the same but for the few that the two dialects spell differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = "C:/Data"
ROOT = "/_webdav/lab/@files/"
QUIET_MS = 21_600_000

SPARK = {
    "ms": lambda c: f"unix_millis(cast({c} as timestamp))",
    "enc": lambda c: (f"replace(replace(replace(replace(url_encode({c}),'+','%20'),'*','%2A'),"
                      f"'%7E','~'),'%40','@')"),
    "bytes": lambda c: f"octet_length({c})",
    "stamp": lambda c: f"timestamp_millis({c})",
}
DUCK = {
    "ms": lambda c: f"(epoch_us({c}) // 1000)",
    "enc": lambda c: f"replace(url_encode({c}),'%40','@')",
    "bytes": lambda c: f"strlen({c})",
    "stamp": lambda c: f"make_timestamp(({c}) * 1000)",
}


def _orders(d: dict) -> dict[str, str]:
    return {
        "k": "o_orderkey",
        "folder": "cast(year(o_orderdate) as string) || '/run' || cast(o_orderkey % 40 as string)",
        "name": (
            "case when o_orderkey % 17 = 0 then '~' when o_orderkey % 19 = 0 then '.' else '' end"
            " || 'acq_' || cast(o_orderkey as string)"
            " || case when o_orderkey % 23 = 0 then ';rep' || cast(o_orderkey % 2 as string)"
            " else '' end"
            " || case when o_orderkey % 29 = 0 then ' é#' else '' end"
            " || case o_orderkey % 6 when 0 then '.raw' when 1 then '.RAW' when 2 then '.wiff'"
            " when 3 then '.notraw' when 4 then '.mzML' else '.csv' end"),
        "size": "cast(round(o_totalprice * 100) as bigint)",
        "ms": d["ms"]("o_orderdate"),
    }


def _ledger(d: dict) -> dict[str, str]:
    state = "(case when k % 2 = 0 then 4 else cast(floor(k / 2) as bigint) % 10 end)"
    folder = "'C:/Data/' || folder || '/'"
    return {
        "k": "k",
        "local_path": f"case when k % 7 = 0 then upper({folder}) else {folder} end || name",
        "remote_path": ("case when k % 11 = 0 then '/_webdav/old/' else '/_webdav/lab/@files/' end"
                        f" || folder || '/' || {d['enc']('name')}"),
        "size": "size + case when k % 13 = 0 then 1 else 0 end",
        "mtime_utc": "ms",
        "md5": "case when k % 20 = 9 then null else md5(cast(k as string)) end",
        "sha256": "cast(null as string)",
        "state": f"cast({state} as int)",
        "verify_method": (f"cast(case when {state} not in (4, 5) then 0 when k % 16 = 6 then 1"
                          " else 2 end as int)"),
        "verified_utc": (f"case when {state} in (4, 5) and k % 16 <> 6 then "
                         f"{d['stamp']('ms + 3600000')} end"),
        "attempts": "cast(k % 8 as int)",
        "last_error": f"case when {state} = 9 then 'error, \"' || cast(k as string) || '\"' end",
        "is_dataset": "false",
        "first_seen_seq": "cast(k as bigint)",
    }


def _remote(d: dict) -> dict[str, str]:
    return {
        "k": "k",
        "folder": "'/_webdav/lab/@files/' || folder || '/'",
        "name": "name",
        "is_collection": "k % 31 = 0",
        "length": ("case when k % 31 = 0 then cast(0 as bigint) else size"
                   " + case when k % 14 = 0 then 7 else 0 end end"),
        "md5": ("case when k % 31 = 0 or k % 20 = 0 then null"
                " when k % 9 = 0 then md5('x' || cast(k as string)) else md5(cast(k as string)) end"),
        "ms": "ms",
    }


def _observations(d: dict) -> dict[str, str]:
    return {
        "path": "'f' || cast(user_id as string) || '.raw'",
        "observed_ms": d["ms"]("ts"),
        "seq": "event_id",
        "length": "cast(floor(value / 100) as bigint)",
        "probe": ("cast(case when event_type = 'error' then 2"
                  " when event_type = 'signup' and event_id % 40 = 0 then 1 else 0 end as int)"),
    }


def _progress(d: dict) -> dict[str, str]:
    state = ("case event_type when 'view' then 1 when 'click' then 2 when 'purchase' then 4"
             " when 'signup' then 5 else 9 end")
    return {
        "local_path": "'p' || cast(event_id % 97 as string) || '.raw'",
        "remote_path": "'/r/p' || cast(event_id % 97 as string) || '.raw'",
        "state": f"cast({state} as int)",
        "phase": ("case event_type when 'view' then 'Checking server' when 'click' then 'Uploading'"
                  " when 'purchase' then 'Verified' when 'signup' then 'Already on the server'"
                  " else '' end"),
        "bytes": "cast(floor(value * 10) as bigint)",
        "total": "cast(5000 as bigint)",
        "rate": "round(value * 1000, 2)",
        "verification": ("cast(case event_type when 'purchase' then 2"
                         " when 'signup' then (event_id % 3) else 0 end as int)"),
        "message": ("case when event_type in ('signup', 'error') then"
                    " 'note ' || cast(event_id as string) end"),
        "seq": "event_id",
        "ts_ms": d["ms"]("ts"),
    }


def _notices(d: dict) -> dict[str, str]:
    return {
        "path": ("'n' || cast(user_id as string) ||"
                 " case when user_id % 5 = 0 then '.tmp' else '.raw' end"),
        "kind": ("case event_type when 'signup' then 'created' when 'view' then 'changed'"
                 " when 'click' then 'renamed' when 'purchase' then 'changed'"
                 " else 'overflow' end"),
        "is_dir": "event_id % 13 = 0",
        "ts_ms": d["ms"]("ts"),
        "seq": "event_id",
    }


def _contents(d: dict) -> dict[str, str]:
    return {
        "doc_id": "doc_id",
        "path": "source || '/' || cast(doc_id as string) || '.txt'",
        "content": "text",
        "length": f"cast({d['bytes']('text')} as bigint)",
        "md5": "md5(text)",
    }


_VIEWS = {
    # name: (source, columns, filter)
    "fx_orders": ("orders", _orders, None),
    "fx_ledger": ("fx_orders", _ledger, "k % 3 <> 0"),
    "fx_remote": ("fx_orders", _remote, "k % 2 = 0 or k % 5 = 0"),
    "fx_observations": ("events", _observations, None),
    "fx_progress": ("events", _progress, None),
    "fx_notices": ("events", _notices, None),
    "fx_contents": ("documents", _contents, None),
    "fx_inventory": ("fx_orders", lambda d: {
        "k": "k", "folder": "folder", "name": "name",
        "path": "'C:/Data/' || folder || '/' || name",
        "length": "size", "mtime_ms": "ms"}, "k % 37 <> 0"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def expressions(view: str) -> list[str]:
    """The columns of a view over a raw table, for a batch or a streaming reader."""
    return [f"{e} as {c}" for c, e in _VIEWS[view][1](SPARK).items()]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, _, condition = _VIEWS[name]
    rows = (view(spark, sf_dir, source) if source in _VIEWS else table(spark, sf_dir, source))
    if condition:
        rows = rows.where(condition)
    return rows.selectExpr(*expressions(name))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_inventory").select("path", "length", "mtime_ms")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_ledger").drop("k")


def remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_remote")


def cte(*names: str, recursive: bool = False) -> str:
    """``WITH`` text that defines the named views and what they stand on."""
    wanted: list[str] = []

    def need(name: str) -> None:
        source = _VIEWS[name][0]
        if source in _VIEWS:
            need(source)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        need(name)
    parts = []
    for name in wanted:
        source, columns, condition = _VIEWS[name]
        fields = ", ".join(f"{e} AS {c}" for c, e in columns(DUCK).items())
        where = f" WHERE {condition}" if condition else ""
        parts.append(f"{name} AS (SELECT {fields} FROM {source}{where})")
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts)
