"""Generic DataFrame operators (filters, listing, aggregate, combine, shape, rank)."""
