"""Training-data operators: one module per operator, `registry` has their queries and SQL."""
