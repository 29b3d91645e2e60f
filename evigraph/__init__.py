"""A PySpark-native engine that turns document collections and code graphs into an evidence graph."""
