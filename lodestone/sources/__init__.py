"""Readers of source trees, manifests and configuration."""
