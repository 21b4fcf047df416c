"""Helpers that shape physical plans: lineage cuts, size checks, dated prefix sums."""
