"""Disclosure-document analytics on Spark DataFrames."""
