from .json_dir import list_manifest, read_documents, read_files
from .tables import read_table

__all__ = ["list_manifest", "read_documents", "read_files", "read_table"]
