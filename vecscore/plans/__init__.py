"""Whole plans: building an index, adapting tables, the registered queries."""
