"""A PySpark-native structural and statistical profiler."""
