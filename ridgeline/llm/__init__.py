"""Training-data operators: search, near copies, line dedup, quality, mixing, language, sharding, tokens, media."""
