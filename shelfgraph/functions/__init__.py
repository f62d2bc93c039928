"""Column functions: typed property values and predicates on them."""
