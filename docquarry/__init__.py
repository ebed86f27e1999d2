"""Docquarry: a Spark-native engine for document retrieval and text pipelines."""
