"""Training-data operators: scoring, deduplication, search, archives, tokens and chat layout."""
