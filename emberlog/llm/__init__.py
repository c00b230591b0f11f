"""Training-data operators: one module each, plus ``registry`` with their queries and SQL.

Nothing outside this package (and ``corpus_pipeline.py`` beside it) imports it.
"""
