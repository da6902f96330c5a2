"""Operators for preparing training text at corpus scale.

Every module holds one operator (a ``DataFrame -> DataFrame`` function); the thin benchmark queries over
``documents`` and ``embeddings`` are in :mod:`revlake.llm.queries`.  Nothing else in the library imports this
subpackage.
"""
