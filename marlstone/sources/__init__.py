"""Readers of the catalog's tables, bodies and protocol files."""
