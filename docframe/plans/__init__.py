from .query import QuerySpec, parse_query
from .view import View

__all__ = ["QuerySpec", "View", "parse_query"]
