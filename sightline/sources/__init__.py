"""Search-visibility analytics: sources."""
