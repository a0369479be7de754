"""Corpus operators for training data: one module each, queries in ``queries``."""
