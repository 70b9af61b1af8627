"""Parsers of landed payloads, catalog files and sinks."""
