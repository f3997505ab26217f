"""Scans of review tables, the review log, context snapshots, and review tables derived from star-schema data."""
