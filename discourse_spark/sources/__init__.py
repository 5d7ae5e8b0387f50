"""Readers and writers for post tables, event calendars and metrics."""
