"""cinderlake: a PySpark-native engine for active-fire analytics."""
