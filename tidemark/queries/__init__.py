"""Registered queries over the test tables, each with its SQL check where one can be written."""
