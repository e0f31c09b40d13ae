"""Training-data operators: tokenizing, sharding, quality, archives, decontamination, joins."""
