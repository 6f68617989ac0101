"""Composite query plans and their SQL."""
