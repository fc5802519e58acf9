"""Fixpoints kept up to date with a stream of edges."""
