"""Quillgraph: question-driven retrieval and extraction over document archives, on Spark."""
