"""The audit export."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stowage.operators.audit import audit_csv_columns


def export_audit_csv(rows: DataFrame, path: str) -> None:
    """Writes a filtered view as CSV parts with headers; a field is quoted only where it must be,
    a quote is doubled, NULL is empty."""
    (audit_csv_columns(rows).write.mode("overwrite").option("header", True)
     .option("escape", '"').option("nullValue", "").option("emptyValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))
