"""DataFrame operators (projection, joins, aggregates, series, learning)."""
