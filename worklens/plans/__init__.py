"""Pipelines built of operators, and the given tables in the shapes that operators take."""
