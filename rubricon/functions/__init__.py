"""Column expressions: every function takes and returns `Column` and stays in the JVM."""
