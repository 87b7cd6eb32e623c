"""Evidence-backed disclosure analytics on PySpark."""
