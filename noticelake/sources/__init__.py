"""Readers and writers: pages, element trees, sitemaps, the notice lake."""
