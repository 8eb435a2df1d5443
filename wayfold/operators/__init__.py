"""Relational, graph, vector, rule and document operators."""
