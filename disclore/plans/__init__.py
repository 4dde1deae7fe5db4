"""Composed plans and the catalogue of queries."""
