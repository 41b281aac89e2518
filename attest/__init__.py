"""attest: evidence and fact analytics as PySpark DataFrame operators."""
