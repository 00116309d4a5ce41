"""Readers of raw exports. Every reader splits large files and keeps their order."""
