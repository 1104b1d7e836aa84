"""Readers of track files."""
