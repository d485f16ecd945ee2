"""tidemark: Spark-native analytics over the history of software repositories."""
