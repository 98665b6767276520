"""Operators for preparing training data, each a set of Spark jobs over tables of documents, pages or vectors."""
