"""Physical-plan helpers (names, skew, size-checked joins) and the query registry."""
