"""Plans above the operators: evaluations, their results, and the query catalog."""
