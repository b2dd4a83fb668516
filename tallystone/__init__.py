"""A Spark-native engine for an auditable memory log, full-text search over it, and training-data pipelines."""
