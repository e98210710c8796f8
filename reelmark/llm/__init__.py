"""Training-data operators: mixing, packing, filters, search, sharding, near duplicates, language, text, tokens."""
