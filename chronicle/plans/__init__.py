"""Canonical views over the driver's tables, the registered queries and the operator registry."""
