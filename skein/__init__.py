"""Skein: retrieval, question-answering and corpus analytics on PySpark."""
