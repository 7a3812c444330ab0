"""Whole-job plans, and the registered queries with their check SQL."""
