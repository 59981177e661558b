"""Column expressions and layout helpers shared by the operators."""
