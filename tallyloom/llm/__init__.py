"""Training-data operators: filtering, near-duplicates, decontamination, search, sharding and packing."""
