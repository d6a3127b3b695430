"""Column expressions with the query language's semantics."""
