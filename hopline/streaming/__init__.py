"""hopline streaming."""
