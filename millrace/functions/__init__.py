"""Helpers shared by the operators: rolling hashes, sorted runs, column expressions."""
