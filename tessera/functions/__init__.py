"""Functions of the user's own, with one rule for nulls."""
