"""Package-compliance analytics on PySpark."""
