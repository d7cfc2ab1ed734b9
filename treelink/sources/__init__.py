"""Readers, writers and generators of edge tables."""
