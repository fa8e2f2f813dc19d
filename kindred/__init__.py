"""kindred: Spark-native record linkage and corpus preparation."""
