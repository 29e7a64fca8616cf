"""DataFrame -> DataFrame operators (filters, joins, aggregates, windows, sampling,
sequence shaping, checks and batch inference)."""
