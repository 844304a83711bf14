"""Column functions: keys, dates, exact arithmetic, text."""
