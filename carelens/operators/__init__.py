"""DataFrame operators: pairing, profiling, evaluation, sampling, vectors,
retrieval, replies, judging, classifier."""
