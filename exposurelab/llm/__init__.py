"""Operators for building language-model training data.

Each module holds one operator; ``queries`` registers them on the tables.
Nothing outside this package imports it.
"""
