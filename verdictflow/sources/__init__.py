from .events import events_from_json, events_from_table, http_events, table_events
from .lists import list_frame, read_list
from .state import CasStore, Snapshot, Versions, WriteBack, expire, merge_latest, range_sum, read_with_fallback
from .topology import load_topology

__all__ = ["CasStore", "Snapshot", "Versions", "WriteBack", "events_from_json", "events_from_table", "expire", "http_events", "list_frame", "load_topology", "merge_latest", "range_sum", "read_list", "read_with_fallback", "table_events"]
