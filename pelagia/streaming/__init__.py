"""Granules as a stream of files."""
