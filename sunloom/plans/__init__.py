"""Plan shapes that Spark has no single operator for: shared tables, fixpoints, as-of and range joins."""
