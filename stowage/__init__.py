"""Stowage: file-inventory reconciliation, transfer ledgers and integrity audits on Spark."""

__version__ = "0.1.0"
