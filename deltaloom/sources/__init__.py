"""Saved relations."""

from .saved import load_relation, save_relation

__all__ = ["load_relation", "save_relation"]
