"""Assembled plans and the registered queries."""
