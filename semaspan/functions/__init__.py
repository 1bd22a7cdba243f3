"""Column functions that run inside the JVM."""
