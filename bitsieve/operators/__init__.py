"""Build, probe and combine filters."""
