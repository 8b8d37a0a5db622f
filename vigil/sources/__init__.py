"""Readers of histories, archives and crawled pages."""
