"""Codecs, record helpers, Bloom filters and text formats."""
