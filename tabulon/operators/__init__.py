"""Relational and analytic operators."""
