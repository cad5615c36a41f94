"""Readers, worksheet decoding and writers."""
