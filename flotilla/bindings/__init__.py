"""Queries over the generated test tables, with equivalent SQL."""
