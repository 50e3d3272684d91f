"""Operators that prepare training text: one module for each of them, queries in ``queries``."""
