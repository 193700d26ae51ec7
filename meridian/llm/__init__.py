"""Training-data operators: each module holds one operator and its query.

Nothing outside this subpackage imports it, so that it can be removed whole.
"""
