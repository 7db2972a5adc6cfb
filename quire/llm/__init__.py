"""Training-data operators: formatting, scoring, filtering, deduplication, packing and archives."""
