"""Column expressions: JVM-side only, no Python UDF."""
