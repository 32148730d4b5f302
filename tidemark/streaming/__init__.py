"""Incremental runs over logs, and subscriptions."""
