"""Training-data operators: dedup, PII, toxicity, language model, tokens, sketches, packing, shards."""
