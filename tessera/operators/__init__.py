"""Operators over map graphs as DataFrame transformations."""
