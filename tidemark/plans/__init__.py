"""Reusable plan shapes: ordered positions, top-n, as-of, size-checked broadcast."""
