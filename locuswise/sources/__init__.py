"""Readers and writers for the supported file formats."""
