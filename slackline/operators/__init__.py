"""Operators over configurations, work functions, state graphs, potentials and candidates."""
