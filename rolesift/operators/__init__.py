"""Operators over canonical postings and company tables."""
