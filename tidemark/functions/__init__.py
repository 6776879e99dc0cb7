"""Column builders: pure expressions without a plan of their own."""
