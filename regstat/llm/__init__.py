"""Operators of a training-data pipeline, each a function on DataFrames.

Nothing else in the library imports this subpackage; its queries are in
``catalog.py`` and the corpus pipeline in ``corpus_pipeline.py`` at the top
of the repository.
"""
