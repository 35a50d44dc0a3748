"""inkmill: a PySpark-native document-quality analytics engine."""
