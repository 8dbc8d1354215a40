"""vecquarry: a PySpark-native engine for vector search, its evaluation and the tables around it."""
