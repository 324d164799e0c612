"""Continuous scans of a drop folder."""
