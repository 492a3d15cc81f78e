"""Readers and versioned tables."""
