"""Where bars, ticks and lists come from, and where results go."""
