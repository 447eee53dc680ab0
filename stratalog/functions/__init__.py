"""Column expressions: predicates that are never null, statistics of arrays, fractions, formats and language tables."""
