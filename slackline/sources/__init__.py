"""Metric generators, stored instances and bindings of other tables to instances."""
