"""Composite jobs: what a user of the library calls."""
