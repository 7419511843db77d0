"""siltwork: a Spark-native engine for document collections, ingestion queues and retrieval."""
