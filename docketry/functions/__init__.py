"""Column expressions: each takes columns and returns one column, all on the JVM side."""
