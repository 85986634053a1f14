"""Retrieval, citation checking and evaluation as Spark DataFrame operators."""
