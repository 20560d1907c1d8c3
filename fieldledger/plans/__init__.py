"""Operators bound to concrete tables, each with its SQL twin where SQL can say it."""
