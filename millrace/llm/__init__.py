"""Training-data operators: language id, token files, dedup, PII, sharding, tokenising, decontamination, extraction."""
