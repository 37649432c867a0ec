"""Readers and writers with explicit schemas."""
