"""Table operators: shaping, de-duplication, joins, loads, contracts, checks, layout."""
