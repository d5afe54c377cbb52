"""Operators: the interval-track algebra and the relational extras Spark lacks."""
