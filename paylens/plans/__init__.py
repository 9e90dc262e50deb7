"""Join policy, plan inspection and the registry of queries with their oracles."""
