"""Bindings and the registry; importing this registers every query."""

from . import payloads, registry, streams  # noqa: F401
