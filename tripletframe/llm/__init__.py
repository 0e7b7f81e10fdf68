"""Training-data operators (deduplication, tokenising, scoring, search, packing) and their queries."""
