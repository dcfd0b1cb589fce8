"""PySpark-native analytics over multi-camera traffic observations."""
