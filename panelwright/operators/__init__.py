"""DataFrame-to-DataFrame operators. Column names are parameters throughout."""
