"""Scalar functions and table functions as column expressions."""
