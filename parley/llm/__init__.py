"""Training-data operators: filtering, sharding, mixing, deduplication, tokens, archives and extraction.

Nothing outside this subpackage imports it.  ``registry`` maps the contract queries to their callables.
"""
