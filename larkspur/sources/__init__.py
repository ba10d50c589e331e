"""Readers of the input tables and the shared folder for intermediate tables."""
