"""A PySpark-native analytics engine for ratings, tags and baskets."""
