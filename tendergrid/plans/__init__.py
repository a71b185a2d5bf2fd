"""Compositions of the operators: marts and loads."""
