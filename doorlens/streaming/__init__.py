"""Structured Streaming versions of the keyed state rules."""
