"""Continuous variants of the batch rules."""
