"""Registered queries: every operator applied to the logical tables, with its SQL counterpart."""
