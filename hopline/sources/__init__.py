"""hopline sources."""
