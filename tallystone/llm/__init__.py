"""Training-data operators: media, tokenising, filtering, deduplication, scoring."""
