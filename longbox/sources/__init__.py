"""Readers, parsers, codecs and writers."""
