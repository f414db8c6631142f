"""hopline operators."""
