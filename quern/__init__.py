"""quern: a PySpark-native engine that prepares training data."""
