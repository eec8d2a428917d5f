"""Training-data operators: mixing, encoding, decontamination, deduplication, archives, search and classifiers."""
