"""Analytics over market time series with Spark: bars, indicators, patterns, screens, signals, backtests and tick streams."""
