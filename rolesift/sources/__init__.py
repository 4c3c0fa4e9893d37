"""Readers: landed payloads, career pages and company lists to canonical rows."""

from rolesift.sources.normalize import normalize
from rolesift.sources.registry import PROVIDERS, register

__all__ = ["PROVIDERS", "normalize", "register"]
