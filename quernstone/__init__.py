"""A Spark-native analytics engine: lazy DataFrame functions and Spark SQL."""
