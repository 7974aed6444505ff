"""Column expressions on cell values and on headers."""
