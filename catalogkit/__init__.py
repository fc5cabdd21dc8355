"""A PySpark engine for building and querying a verified content catalog."""
