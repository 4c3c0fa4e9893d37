"""Posting analytics as Spark DataFrame plans."""
