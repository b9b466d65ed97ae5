"""Whole studies, and the registered queries that exercise every operator."""
