"""Operators on the chunk table and on tables of hits, answers and runs."""
