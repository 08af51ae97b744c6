"""Whole plans: configuration, the compression pipeline, replay, explain, scenarios."""
