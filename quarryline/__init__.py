"""PySpark-native engine for indexing and querying documents and code."""
