"""Prose quality analytics on Spark."""
