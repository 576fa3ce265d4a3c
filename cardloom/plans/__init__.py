"""Registered queries and their fixtures."""
