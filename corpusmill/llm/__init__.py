"""Operators for building training data for language models.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it. Every operator is a
function from DataFrame to DataFrame; ``queries.py`` registers the digest queries on top.
"""
