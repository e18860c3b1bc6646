"""Column expressions and small DataFrame helpers shared by all operators."""
