"""Column functions: text handling with Python string semantics, built from Spark built-ins."""
