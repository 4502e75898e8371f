"""Feeding fixpoints from streams."""

from .incremental import feed

__all__ = ["feed"]
