"""Registered queries: each operator over the driver tables, with its SQL counterpart."""
