"""spanloom: span and trace analytics on PySpark."""
