"""Landed raw payloads -> article rows."""
