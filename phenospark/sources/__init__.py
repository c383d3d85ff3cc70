"""Readers of tracking tables, outlines and frame images, and the writer of viewer tables."""
