"""Registered checks, one module per operator family."""

from marketmap.plans.checks import classify, monitor, sites, sources, streams, taxonomy, text  # noqa: F401
