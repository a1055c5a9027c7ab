"""Column functions: geography and scalar rules."""
