"""Operators for building language-model training data from Spark tables."""
