"""skyframe: a PySpark-native analytics engine for sky images and the tables derived from them."""
