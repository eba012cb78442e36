"""Scoring of streams: the batch projections applied to ``readStream``."""
