"""Readers and writers of the formats records come in."""
