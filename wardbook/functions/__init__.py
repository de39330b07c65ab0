"""Column expressions: predicates, binning, number handling, intervals, literals."""
