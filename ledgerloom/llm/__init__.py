"""Operators for preparing language-model training data at corpus scale.

Nothing else in the library imports this subpackage. Each module holds one operator; ``queries``
registers the driver's queries and ``corpus_pipeline.py`` at the repository top chains five of them.
"""
