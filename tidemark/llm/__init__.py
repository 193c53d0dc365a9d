"""Operators for building training data from text; nothing else in the package imports this one."""
