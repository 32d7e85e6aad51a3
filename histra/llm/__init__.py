"""Training-data operators (dedup, search, filtering, packing, mixing). Nothing outside this package imports it."""
