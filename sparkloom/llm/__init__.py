"""Training-data operators: language ID, mixing, near-duplicate join, PII, exact
top-k, URL filter, perplexity rules, licence scan, packing and toxicity."""
