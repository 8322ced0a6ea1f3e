"""A PySpark-native engine for entity resolution, control graphs and corpus screening."""
