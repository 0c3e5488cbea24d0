"""Readers, writers and the mapping from the TPC-H-like tables."""
