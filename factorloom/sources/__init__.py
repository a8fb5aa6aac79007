"""Readers and writers of panels, market text, reports, libraries and logs."""
