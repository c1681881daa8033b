"""Registered queries of the core, with their SQL."""
