"""Continuous queries and their consumers."""
