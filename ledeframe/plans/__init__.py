"""Composed query plans and the registry of checkable queries."""
