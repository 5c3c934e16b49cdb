"""Operators on DataFrames: labels, comparisons, audits, features, scores."""
