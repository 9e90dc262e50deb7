"""Training-data operators: sharding, fingerprints, dedup, tokens, archives, mixing, quality.

Nothing else in the library imports this subpackage.
"""
