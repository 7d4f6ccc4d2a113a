"""Report files and report-shaped tables."""
