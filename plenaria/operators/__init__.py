"""Relational, ranking, statistical and interval operators."""
