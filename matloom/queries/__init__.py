"""Registered queries with their SQL."""
