"""Schemas of the tables the operators exchange."""

from __future__ import annotations

PACKAGES = """
pkg_id STRING, pkg_seq BIGINT, root_path STRING, name STRING, package_id STRING,
supported_versions ARRAY<STRING>, source_lang_dir STRING
"""

# ``pos`` is the Dewey label of a node: the ordinals on the way down from the
# document root. A node's parent is its prefix and array order is document order.
NODES = """
file_id STRING, pkg_id STRING, pos ARRAY<INT>, tags ARRAY<STRING>, tag STRING,
attrs MAP<STRING,STRING>, text STRING, is_comment BOOLEAN, has_bom BOOLEAN,
parse_error STRING
"""

UNITS = """
unit_id STRING, pkg_id STRING, file_id STRING, channel STRING, def_type STRING,
type_key STRING, out_path STRING, layer INT, sort_path STRING, seq BIGINT, key STRING,
is_comment BOOLEAN, has_bom BOOLEAN, source_text STRING
"""

STATE = """
kind STRING, pkg_id STRING, lang STRING, channel STRING, type_key STRING, key STRING,
text STRING, origin STRING, deleted BOOLEAN
"""

MEMORY = """
src_lang STRING, tgt_lang STRING, source_text STRING, target_text STRING, seq BIGINT
"""

# What makes a unit unique. Keys are only unique inside a channel and type: two
# definitions of different types may share a name. ``type_key`` is the short type,
# never null, since units of one definition may stand under two type names.
TYPED_KEY = ["pkg_id", "channel", "type_key", "key"]
FLAT_KEY = ["pkg_id", "key"]


def key_columns(scope: str) -> list[str]:
    if scope == "typed":
        return list(TYPED_KEY)
    if scope == "flat":
        return list(FLAT_KEY)
    raise ValueError(f"unknown key scope: {scope!r}")
