"""Readers of detection feeds, plant registries and map extracts."""
