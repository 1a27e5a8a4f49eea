"""Relational operators: views, joins, windows, sets, graphs."""
