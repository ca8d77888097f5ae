"""Incremental generation over newly arrived rows."""
