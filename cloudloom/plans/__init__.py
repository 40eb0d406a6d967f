"""Registered queries over the shared test tables."""
