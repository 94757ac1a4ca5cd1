"""Readers and writers for text, markup, subtitles and results."""
