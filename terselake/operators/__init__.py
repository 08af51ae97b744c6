"""Operators: structure collapse, relevance trimming, dedup, analytics."""
