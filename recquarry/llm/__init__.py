"""Operators for building language-model training data from very large document tables."""
