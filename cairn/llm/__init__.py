"""Operators of a training-data pipeline over ``documents`` / ``pages`` tables.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports
it. ``queries.py`` holds the thin registered queries.
"""
