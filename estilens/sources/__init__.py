"""Readers for the review tables."""
