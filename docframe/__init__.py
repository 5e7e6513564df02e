"""Document-style tables on Spark: keys, indexes, associations, search, one nested-dict query."""

from .database import Database
from .functions.conditions import Sort
from .gsi import GSI
from .table import Table

__version__ = "0.1.0"
__all__ = ["GSI", "Database", "Sort", "Table", "__version__"]
