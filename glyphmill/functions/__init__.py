"""Scalar functions: one Column expression per correction rule, and the Arrow functions that Spark has no built-in for."""
