"""Readers, venue-payload parsers, table schemas and sinks."""
