"""Readers, writers and the access-event view."""
