"""Indicators, patterns, levels and prices as columns."""
