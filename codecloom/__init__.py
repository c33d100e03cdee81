"""Compressed binary columns on Spark: codecs, dictionaries, chunk streams and content negotiation."""

__version__ = "0.1.0"
