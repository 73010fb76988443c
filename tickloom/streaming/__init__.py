"""Tick streams."""
