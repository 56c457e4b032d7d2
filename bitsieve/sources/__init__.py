"""Readers and writers of filters and measurements."""
