"""Filters kept up to date by streams."""
