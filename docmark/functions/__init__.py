"""Column expressions: each takes and returns ``Column`` and stays inside the JVM."""
