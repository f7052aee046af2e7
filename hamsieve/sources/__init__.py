"""Readers, writers, shared scratch space and the model registry."""
