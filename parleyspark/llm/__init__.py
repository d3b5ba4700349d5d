"""Operators on training text and its collections. Nothing else in the library imports this subpackage."""
