"""Whole-review plans assembled from the operators."""
