"""pagewright: Spark-native analytics over captured web archives."""
