"""Readers and writers for the artifact formats."""
