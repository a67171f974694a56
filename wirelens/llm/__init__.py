"""Training-data operators: dedup, extraction, language ID, scans, sharding, mixing, tokens."""
