"""Screens, strategies, backtests and searches."""
