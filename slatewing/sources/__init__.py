"""Declared types, catalogs, files and indexes."""
