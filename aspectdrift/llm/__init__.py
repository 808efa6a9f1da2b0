"""Training-data operators: language id, mixing, dedup, packing, quality, licences, secrets, archives."""
