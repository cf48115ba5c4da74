"""Column builders: boxes and vectors."""
