"""The queries and their SQL."""
