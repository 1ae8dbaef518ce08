"""DataFrame operators: search, ranking, change sets, deduplication, trees, chunks."""
