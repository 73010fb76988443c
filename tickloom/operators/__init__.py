"""Operators over ordered bars: windows, folds, resampling, joins and data quality."""
