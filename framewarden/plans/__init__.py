"""Whole queries: fixtures, the flagship, and the registry of queries with their SQL."""
