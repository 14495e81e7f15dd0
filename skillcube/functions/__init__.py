"""Column functions: IEEE-safe arithmetic, the normal distribution, weights."""
