"""Gleaner: find near-duplicate records, group them, score them and keep the best, on Spark."""
