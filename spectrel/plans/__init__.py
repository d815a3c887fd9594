"""Fixtures and registered queries."""
