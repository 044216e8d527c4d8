"""Relational and statistical operators: ``DataFrame -> DataFrame``."""
