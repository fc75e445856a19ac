"""Operators for cleaning and mixing text corpora."""
