"""Relational operators on movies and factor tables."""
