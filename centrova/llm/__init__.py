"""Training-data operators: deduplication, filtering, decontamination, scoring and mixing of text."""
