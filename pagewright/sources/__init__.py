"""Readers and writers: tables, raw archives, manifests and state files."""
