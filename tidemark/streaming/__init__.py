"""Journals in motion: publishing, subscriptions, stateful processing."""
