"""Column functions: rounding, time, text and test statistics."""
