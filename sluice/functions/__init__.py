"""Sluice subpackage."""
