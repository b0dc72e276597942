"""Vectorised helpers that run inside tasks."""
