"""Writers with side effects: copies, sidecars, the ledger table and exports."""
