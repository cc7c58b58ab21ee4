"""Readers of pages, site files and documents."""
