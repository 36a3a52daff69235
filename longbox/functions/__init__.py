"""Column functions: text, numbers, time, natural order."""
