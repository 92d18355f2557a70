"""Whole workflows composed of operators, and the registered queries."""
