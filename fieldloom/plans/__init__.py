"""Composed protocols and the registered queries."""
