"""DataFrame operators: joins, aggregates, order-sensitive selection, deduplication, comparison."""
