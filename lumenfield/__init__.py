"""Crowded-field catalogue analytics on Spark."""
