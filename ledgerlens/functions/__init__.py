"""Column-level helpers (all JVM-side built-in expressions)."""
