"""Readers of raw corpora and writers of results."""
