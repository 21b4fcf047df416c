"""Unbounded input: files that arrive, roll-ups folded per micro-batch, windows with late data."""
