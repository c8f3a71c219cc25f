"""Training-data operators: mixing, quality, near-dedup, language, extraction, secrets, sharding,
decontamination, substring dedup and toxicity.  Nothing outside this subpackage imports it."""
