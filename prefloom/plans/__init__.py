"""Whole chains of operators, the inputs derived for them, and the query catalog."""
