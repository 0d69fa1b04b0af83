"""Registered queries of the crawl engine with the SQL that states the same results."""
