"""Training-data operators: quality, tokenization, extraction, deduplication and packing."""
