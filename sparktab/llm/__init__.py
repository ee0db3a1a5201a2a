"""Operators for training-data pipelines over documents, web pages and conversations.

Nothing outside this folder, `corpus_pipeline.py` and `__spark_entry__.py` imports it.
"""
