"""Column expressions: spans, patterns, addresses, names, entities, pseudonyms, layout."""
