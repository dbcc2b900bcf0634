"""Billing, credit and portfolio analytics as PySpark DataFrame operators."""
