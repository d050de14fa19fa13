"""Readers and page extraction, and the writers that mirror them."""
