"""Flight-surveillance and schedule analytics as plain Spark jobs."""
