"""Configured compositions of operators."""
