"""Inventory and canonicalization of document equations on Spark."""
