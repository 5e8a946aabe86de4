"""Operators for building language-model training data.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its
queries when it is present.
"""
