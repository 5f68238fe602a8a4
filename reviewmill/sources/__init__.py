"""Readers of review exports and tables, and the tables a run writes."""
