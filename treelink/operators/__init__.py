"""Relational operators on edge tables: preparation, splits, sampling, scoring, training and metrics."""
