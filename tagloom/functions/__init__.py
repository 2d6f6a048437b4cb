"""Column functions: normalisation keys and text predicates."""
