"""Relational operators over artifacts, facts and findings."""
