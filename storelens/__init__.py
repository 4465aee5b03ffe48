"""Brand reports over marketplace tables, as PySpark DataFrame functions."""
