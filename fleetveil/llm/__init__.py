"""Training-data operators: packing, filtering, tokenising and deduplicating documents."""
