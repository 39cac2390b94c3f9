"""A PySpark-native engine for document indexing, retrieval and change-log analytics."""

__version__ = "0.1.0"
