"""The status report: what the ledger says was transferred."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from stowage.functions.labels import state_name
from stowage.operators.audit import (
    ALL, attention_top, audit_report, audit_summary, audit_view)
from stowage.operators.ledger import count_by_state


@dataclass
class Status:
    counts: DataFrame
    attention: DataFrame
    rows: DataFrame
    summary: DataFrame


def status(ledger: DataFrame, filter: str = ALL, search: str = "") -> Status:
    """Counts by state, the newest rows that need a person, the audit table and its summary."""
    view = audit_view(ledger, filter, search)
    counts = count_by_state(ledger)
    return Status(counts.withColumn("name", state_name(counts["state"])), attention_top(ledger),
                  audit_report(view), audit_summary(ledger, view))
