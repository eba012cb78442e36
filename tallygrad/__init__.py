"""Meter-series preparation and feed-forward regression as Spark jobs."""
