"""Operators for preparing training data, at corpus scale.

Nothing outside this folder imports it; ``queries`` holds the registered queries and their SQL.
"""
