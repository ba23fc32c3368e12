"""Registered queries with their SQL counterparts, one module per family."""
