"""Part of inkmill."""
