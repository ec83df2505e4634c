"""Column functions and the fixed patterns they use."""
