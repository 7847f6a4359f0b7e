"""Search-visibility analytics: operators."""
