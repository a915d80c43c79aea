"""A PySpark-native analytics engine for card-game decision data."""
