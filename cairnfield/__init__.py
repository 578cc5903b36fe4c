"""Queries over vector feature layers on Spark."""
