"""A versioned, ordered key-value analytics engine on PySpark."""
