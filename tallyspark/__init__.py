"""Bank-statement analytics as PySpark DataFrame transformations."""
