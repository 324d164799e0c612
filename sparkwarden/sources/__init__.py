"""Artifact readers and registry dimensions."""
