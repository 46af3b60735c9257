"""tidemark: a Spark-native engine for market-bar analytics."""
