"""Training-data operators: filters, near-duplicates, scoring, tokenising and packing."""
