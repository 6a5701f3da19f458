"""Streams that keep indexes, sessions and job states up to date."""
