"""A Spark-native engine for JSON documents and JSON Schema at table scale."""
