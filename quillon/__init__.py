"""quillon: a Spark-native multi-model analytics engine."""
