"""Training-data operators: search, licences, packing, scoring, deduplication, mixing, token files."""
