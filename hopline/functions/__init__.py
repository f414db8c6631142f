"""hopline functions."""
