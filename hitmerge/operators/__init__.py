"""DataFrame operators: merging, deduplication, coherence, reachability, status, quality."""
