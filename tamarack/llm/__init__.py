"""Operators for building training data from corpus tables."""
