"""A PySpark-native engine for document retrieval, ranking and corpus analytics."""
