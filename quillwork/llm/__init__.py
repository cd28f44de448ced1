"""Training-data operators: packing, scoring, scanning, encoding and deduplication of whole corpora."""
