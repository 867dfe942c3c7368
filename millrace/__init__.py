"""A PySpark-native engine for retrieval, conversation analytics and dataset curation."""
