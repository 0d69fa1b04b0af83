"""Expressions over URLs, texts, durations, failures and pictures."""
