"""Column expressions: paths, ledger rules and display text."""
