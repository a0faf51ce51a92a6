"""Spark-native inspection and reshaping of documents, pages, files and their metadata."""
