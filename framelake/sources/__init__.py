"""Readers and writers of movies."""
