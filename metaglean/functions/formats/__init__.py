"""Handlers by format: structure, types, read, remove and inject over whole files as bytes."""
