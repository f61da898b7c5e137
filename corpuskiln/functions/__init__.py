"""Column expressions: text features, tokens and hashes. All run inside the JVM."""
