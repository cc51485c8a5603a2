"""Readers, writers and checks of stored data."""
