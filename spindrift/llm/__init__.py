"""Operators for preparing language-model training data, each a DataFrame to DataFrame function."""
