"""Operators for preparing language-model training data at cluster scale.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries when it is present.
"""
