"""Journals at rest: reading, appending."""
