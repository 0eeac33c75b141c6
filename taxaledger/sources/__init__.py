"""Inputs and outputs: sheets, reference tables, study areas, result tables."""
