"""Query catalogue and whole-run plans."""
