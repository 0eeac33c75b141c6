"""Composite jobs: the public entry points, built from the operators."""
