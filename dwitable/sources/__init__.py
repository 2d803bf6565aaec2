"""Readers: object listings, participant files, sidecars, matrix text, reports."""
