"""Operators of a training-data pipeline: ten operators over documents, embeddings and pages.

Nothing else in the package imports this subpackage; ``__spark_entry__.py`` adds its
queries when it is present.
"""
