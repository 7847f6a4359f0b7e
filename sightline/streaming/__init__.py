"""Search-visibility analytics: streaming."""
