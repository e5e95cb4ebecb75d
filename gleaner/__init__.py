"""Corpus building, hybrid retrieval and evaluation as DataFrame plans."""
