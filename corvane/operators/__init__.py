"""Relational operators: nesting, lookups, sampling, ranking, boxes, components."""
