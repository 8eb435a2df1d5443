"""Browsing-knowledge analytics on Spark."""
