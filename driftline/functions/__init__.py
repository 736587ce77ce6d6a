"""Column functions; each builds an expression that Spark evaluates in the JVM."""
