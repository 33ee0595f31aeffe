"""Streaming forms of the measures that are sums."""
