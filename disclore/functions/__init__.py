"""Scalar functions: Column in, Column out."""
