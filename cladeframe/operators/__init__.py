"""Operators on trees, mutations, sequences, variants and graphs."""
