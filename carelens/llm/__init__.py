"""Training-data operators over whole corpora."""
