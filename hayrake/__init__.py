"""Hybrid retrieval and candidate ranking as DataFrame plans."""
