"""Tabular operators; importing the package registers all of them."""

from sluice.operators import combine, core, graph, shape  # noqa: F401
