"""Column layouts shared by the operators."""

from __future__ import annotations

SNAPSHOT = "snapshot"
BOOKMARK = "bookmark"
TMP_BOOKMARK = "tmp_bookmark"

# Reserved tag prefix of temporary bookmarks; sites with another convention pass their own prefix.
TMP_PREFIX = ".TMP."

SNAPSHOTS = (
    "side STRING, root STRING, dataset STRING, rel_dataset STRING, kind STRING, tag STRING, name STRING, "
    "guid STRING, creation BIGINT, createtxg BIGINT, written BIGINT, held BOOLEAN"
)
DATASETS = (
    "side STRING, root STRING, dataset STRING, rel_dataset STRING, is_volume BOOLEAN, recordsize BIGINT, "
    "snapshots_changed BIGINT"
)
PROPERTIES = "dataset STRING, property STRING, value STRING, source STRING"
STATE = "namespace STRING, dataset STRING, family STRING, label_key STRING, created BIGINT, changed BIGINT"
PROGRESS = "file STRING, seq BIGINT, line STRING, terminator STRING, ts TIMESTAMP"

# A GUID is an unsigned 64-bit number: always text, never BIGINT.
SNAPSHOT_ORDER = ("createtxg", "creation", "tag")
COMPARISON_ORDER = ("creation", "createtxg", "tag")
COMPARISON_COLUMNS = (
    "location", "creation_iso", "createtxg", "rel_name", "guid", "root_dataset", "rel_dataset", "name",
    "creation", "written",
)
