"""Column expressions: no storage, no shuffles."""
