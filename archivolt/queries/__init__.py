"""Thin queries over the driver's tables, one module per group of operators."""
