"""Column functions: dates and periods, null-safe arithmetic, text, scores."""
