"""Column helpers: every function takes and returns Columns."""
