"""Relational operators over response tables."""
