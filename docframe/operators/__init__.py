from .integrity import violations
from .refresh import ChangeSummary, diff_frames, diff_manifests
from .search import matching, postings, search_all
from .upsert import delete_keys, last_write, upsert
from .write import JsonWriter

__all__ = ["ChangeSummary", "JsonWriter", "delete_keys", "diff_frames", "diff_manifests", "last_write", "matching", "postings", "search_all", "upsert", "violations"]
