"""The registered queries: every operator over the given tables, each with its SQL twin."""
