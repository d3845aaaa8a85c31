from rankfold.sources.events import (
    FLAT_SCHEMA,
    conform_flat,
    discover_sizes,
    listen_threshold,
    read_event_kinds,
    read_events,
    read_sequences,
)
from rankfold.sources.adapters import embedding_tables, event_kind_tables, interactions, multi_event
from rankfold.sources.sinks import (
    load_embeddings,
    resolve_output_path,
    save_embeddings,
    write_csv,
    write_metrics_json,
    write_parquet,
)

__all__ = [
    "FLAT_SCHEMA", "conform_flat", "discover_sizes", "listen_threshold", "read_event_kinds", "read_events",
    "read_sequences", "embedding_tables", "event_kind_tables", "interactions", "multi_event",
    "load_embeddings", "resolve_output_path", "save_embeddings", "write_csv", "write_metrics_json",
    "write_parquet",
]
