"""Readers: the tables, and the derived views over them."""
