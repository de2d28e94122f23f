"""Schemas of the engine's tables."""

RECORDS = (
    "volume long, node long, parent_node long, path string, name string, kind string, len long, mode int, owner int, `group` int, xattrs_digest long, "
    "created timestamp, modified timestamp, changed timestamp, hidden boolean, tags array<string>, finder_comment string"
)
CONTENT = "volume long, node long, text string"
EVENTS = "seq long, lane string, path string, kind string, `from` string, `to` string, observed_at timestamp"
EXTRACTED = "path string, format string, status string, reason string, bytes_read long, text string"
