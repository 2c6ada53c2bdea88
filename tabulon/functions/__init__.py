"""Column functions with defined null and number semantics."""
