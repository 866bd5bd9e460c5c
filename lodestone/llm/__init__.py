"""Training-data operators: media, packing, sharding, BPE, near-dedup, LM and toxicity scoring, quality rules, HTML."""
