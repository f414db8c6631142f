"""hopline plans."""
