"""Training-data operators: packing, dedup, quality, mixing, extraction, fingerprints, secrets, toxicity."""
