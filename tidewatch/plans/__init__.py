"""Registered queries over the bound tables, with their SQL counterparts."""
