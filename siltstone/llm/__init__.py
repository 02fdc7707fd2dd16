"""Training-data operators: one module per operator, each with its queries and SQL."""
