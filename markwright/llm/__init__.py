"""Operators for large training-data pipelines.

Self-contained: nothing else in the library imports this subpackage.
"""
