"""Column helpers: plain functions from Columns to Columns."""
