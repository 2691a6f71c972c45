"""Operators of a training-data pipeline: rules, scoring, near copies, formatting, tokens, mixing.

Nothing else in the library imports this subpackage.
"""
