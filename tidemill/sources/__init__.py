"""Readers for the delimited text layouts and writers for key/value text."""
