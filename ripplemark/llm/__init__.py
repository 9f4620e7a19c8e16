"""Operators for preparing large text and vector collections. Nothing else in the package imports them."""
