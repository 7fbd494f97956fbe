"""Training-data operators: fingerprints, secret and personal-data scans, deduplication, mixing, tokenizing, chat formatting."""
