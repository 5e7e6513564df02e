from .conditions import Condition, Sort, parse_condition
from .text import tokens
from .values import Value, order_key, value_of

__all__ = ["Condition", "Sort", "Value", "order_key", "parse_condition", "tokens", "value_of"]
