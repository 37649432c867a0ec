"""Column expressions: each function maps columns to a column and stays inside the JVM."""
