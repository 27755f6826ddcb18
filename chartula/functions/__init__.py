"""Column builders: every function takes columns and returns a column."""
