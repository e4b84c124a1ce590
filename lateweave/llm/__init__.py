"""Training-data pipeline operators: deduplication, tokens, records, classifiers, packing."""
