"""Whole plans: feature sets, the walk-forward workflow and the query catalogue."""
