"""Operators for preparing language-model training data.

Each module holds one operator with its own general interface and, at its
end, the query that applies it to the standard tables.  ``registry`` lists
the queries; nothing outside this folder imports it except
``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
