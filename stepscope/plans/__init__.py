"""End-to-end reports built from the operators, and the registered query catalogue."""
