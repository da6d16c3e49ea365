"""Whole reviews composed of operators."""
