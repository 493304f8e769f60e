"""Registered queries: operators composed over tables."""
