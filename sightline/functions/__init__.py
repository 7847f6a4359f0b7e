"""Search-visibility analytics: functions."""
