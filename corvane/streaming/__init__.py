"""Keyed state over ordered streams, in batch and streaming form."""
