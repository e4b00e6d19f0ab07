"""Training-data operators: packing, extraction, token files, filters, mixing, dedup and PII."""
