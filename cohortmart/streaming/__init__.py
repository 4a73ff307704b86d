"""Streams of score files."""
