"""Readers: mirrored files, JSON lines, evaluation sets, profiles."""
