"""Scans and sinks: configuration, JSON lines, sitemaps, robots rules, fetched pages, keyed tables, history."""
