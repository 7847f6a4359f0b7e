"""Search-visibility analytics: plans."""
