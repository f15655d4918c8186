"""Queries pN_... and their SQL."""
