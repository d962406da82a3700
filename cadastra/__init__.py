"""Property-market and territorial analytics as PySpark DataFrame plans."""
