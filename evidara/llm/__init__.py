"""Training-data operators: search, deduplication, decontamination, scoring, archives, mixing, token files."""
