"""Relational operators on transit tables."""
