"""Part of the revision comparison library."""
