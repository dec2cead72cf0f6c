"""Registered queries and their SQL counterparts, by theme."""
