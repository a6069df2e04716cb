"""Operators for training-data pipelines over tables of documents.

Every operator takes DataFrames with at least an integer ``doc_id`` and a string ``text`` and
returns DataFrames. Nothing outside this package imports it.
"""
