"""Tables: declared schemas, readers that give every row its place, fixed dimensions and label maps, and writers."""

from notegrid.sources.sinks import field_table, index_table, map_table, page_paths, source_matrix, text_list, url_write_back, write_table
from notegrid.sources.tables import (
    ASSET, CATEGORY, CONFIDENCE_LABELS, DESCRIPTOR, DIMENSION_IDS, DIMENSIONS, EVIDENCE_LABELS, MODALITY_LABELS, SOURCE, STATUS_LABELS, dimension_table, label_table, marked_table, new_path, raw_table, read_table, request_state, stored, with_ordinal,
)

__all__ = [
    "ASSET", "CATEGORY", "CONFIDENCE_LABELS", "DESCRIPTOR", "DIMENSIONS", "DIMENSION_IDS", "EVIDENCE_LABELS", "MODALITY_LABELS", "SOURCE", "STATUS_LABELS", "dimension_table",
    "field_table", "index_table", "label_table", "map_table", "marked_table", "new_path", "page_paths", "raw_table", "read_table", "request_state", "source_matrix", "stored", "text_list", "url_write_back", "with_ordinal", "write_table",
]
