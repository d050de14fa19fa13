"""DataFrame in, DataFrame out: filters, joins, de-duplication, aggregation, ranking."""
