"""Incremental reading of metadata and page files as they land."""
