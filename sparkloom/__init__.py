"""A PySpark-native property-graph and corpus toolkit."""
