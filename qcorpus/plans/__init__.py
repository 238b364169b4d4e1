"""Derived fixtures and the registered queries."""
