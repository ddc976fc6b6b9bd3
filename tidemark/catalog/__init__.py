"""Registered queries over the derived views, by topic."""
