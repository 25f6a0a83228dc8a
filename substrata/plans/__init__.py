"""Kernels and strategies that the operators choose from, and the catalogue of queries."""
