"""Plans: the candidate pipeline, the filing scan and the registered queries."""
