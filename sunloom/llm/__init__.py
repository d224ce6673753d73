"""Training-data operators: sharding, packing, quality, token files, fingerprints, joins."""
