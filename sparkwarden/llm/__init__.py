"""Training-data operators: filtering, de-duplication, mixing, packing and search.

Nothing outside this subpackage imports it.  ``queries`` holds the thin
contract queries, every other module one operator with a general interface.
"""
