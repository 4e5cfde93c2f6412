"""The policy, the curation flow and the registered queries."""
