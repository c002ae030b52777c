"""Tidemark: news and metric analytics as Spark DataFrame operators."""
