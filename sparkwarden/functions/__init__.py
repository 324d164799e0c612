"""Scalar functions as Column expressions, and the Lua front end."""
