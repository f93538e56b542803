"""tessera: a PySpark-native analytics engine."""
