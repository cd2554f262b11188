"""Training-data operators: scans, deduplication, classification, tokenising."""
