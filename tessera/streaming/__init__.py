"""Streams: sources that remember where they stood."""
