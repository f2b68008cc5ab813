"""Catalogue of registered queries and their SQL checks."""
