"""Column builders: everything here is a pure expression on one row."""
