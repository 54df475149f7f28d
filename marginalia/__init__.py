"""Training-corpus preparation and evaluation as DataFrame operators."""

from .session import configure

__all__ = ["configure"]
