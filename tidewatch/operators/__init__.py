"""Relational, vector, clustering and lifecycle operators."""
