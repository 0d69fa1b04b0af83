"""Relational operators of the crawl engine."""
