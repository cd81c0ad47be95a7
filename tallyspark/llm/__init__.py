"""Operators of a training-data pipeline. One module per operator; ``queries`` binds them to the given tables."""
