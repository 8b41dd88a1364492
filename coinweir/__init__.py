"""Personal-finance analytics as DataFrame operators on PySpark."""
