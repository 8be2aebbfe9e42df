"""threadloom: a Spark-native engine for mailing-list knowledge bases."""
