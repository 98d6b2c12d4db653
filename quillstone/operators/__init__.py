"""DataFrame operators over propositions, mentions, provenance, entities and edges."""
