"""Readers and writers of the engine's interchange formats."""
