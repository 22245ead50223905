"""Operators for preparing language-model training data at corpus scale.

Nothing else in the library imports this subpackage; ``queries`` registers its
queries and ``corpus_pipeline.py`` at the repository top chains five of them.
"""
