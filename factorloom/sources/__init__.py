"""Readers, payload mappings and stored snapshots."""
