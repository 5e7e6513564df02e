from .ingest import ingest_json, ingest_table, watch_changes

__all__ = ["ingest_json", "ingest_table", "watch_changes"]
