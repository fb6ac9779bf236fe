"""folio: a PySpark-native engine for recognised document text."""
