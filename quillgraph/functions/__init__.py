"""Column functions, predicates and expressions."""
