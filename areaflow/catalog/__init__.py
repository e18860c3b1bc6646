"""Registered queries: each operator on the stand-in views, with its SQL oracle."""
