from .registry import all_queries

__all__ = ["all_queries"]
