"""Column functions. All stay in the JVM unless their name ends in _py."""
