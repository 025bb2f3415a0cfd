"""Column types of the stored tables and fixed vocabularies of the data model."""

from pyspark.sql import types as T

TAGS = T.ArrayType(T.StringType())

RELATIONS = T.ArrayType(T.StructType([
    T.StructField("relation_type", T.StringType()),
    T.StructField("target_id", T.StringType()),
    T.StructField("context_label", T.StringType()),
]))

TIER_HISTORY = T.ArrayType(T.StructType([
    T.StructField("from", T.StringType()),
    T.StructField("to", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("at", T.StringType()),
    T.StructField("access_count", T.LongType()),
]))

PROVENANCE = T.StructType([
    T.StructField("shared_from_space", T.StringType()),
    T.StructField("shared_from_memory", T.StringType()),
    T.StructField("shared_by_user", T.StringType()),
    T.StructField("shared_by_agent", T.StringType()),
    T.StructField("shared_at", T.StringType()),
    T.StructField("original_created_at", T.StringType()),
    T.StructField("source_version", T.LongType()),
])

# Columns kept as JSON text in stored memories, with the type they decode to.
JSON_COLUMNS = {
    "tags": TAGS,
    "relations": RELATIONS,
    "tier_history": TIER_HISTORY,
    "provenance": PROVENANCE,
}

# Defaults of a stored memory when a column is missing.
MEMORY_DEFAULTS = {
    "memory_type": ("string", "insight"),
    "state": ("string", "active"),
    "tier": ("string", "peripheral"),
    "importance": ("double", 0.5),
    "confidence": ("double", 0.5),
    "access_count": ("int", 0),
    "scope": ("string", "global"),
    "space_id": ("string", ""),
    "visibility": ("string", "global"),
    "owner_agent_id": ("string", ""),
    "version": ("bigint", 1),
    "is_cluster_anchor": ("boolean", False),
}

# Default categories.
# (name, always_merge, append_only, temporal_versioned, merge_supported,
#  admission_weight, importance_base, default_ttl_days, sort_order)
DEFAULT_CATEGORIES = [
    ("preferences", False, False, True, True, 0.90, 0.70, None, 0),
    ("identity", True, False, False, False, 0.75, 0.80, None, 1),
    ("emotional", False, True, False, False, 0.65, 0.55, None, 2),
    ("project", False, False, True, True, 0.70, 0.60, None, 3),
    ("work", False, True, False, False, 0.55, 0.45, 90, 4),
    ("lessons_learned", False, False, False, True, 0.85, 0.70, None, 5),
    ("decisions", False, True, False, False, 0.80, 0.75, None, 6),
    ("success_patterns", False, False, False, True, 0.85, 0.65, None, 7),
    ("mistakes", False, False, False, True, 0.80, 0.60, None, 8),
]
CATEGORY_SCHEMA = (
    "name string, always_merge boolean, append_only boolean, temporal_versioned boolean, "
    "merge_supported boolean, admission_weight double, importance_base double, "
    "default_ttl_days int, sort_order int"
)

# Category aliases.
DEFAULT_ALIASES = [
    ("likes", "preferences"), ("dislikes", "preferences"), ("hobbies", "preferences"),
    ("identity_rules", "identity"), ("feelings", "emotional"), ("emotions", "emotional"),
    ("projects", "project"), ("project_context", "project"), ("work_memory", "work"),
    ("working", "work"), ("lessons", "lessons_learned"), ("lesson", "lessons_learned"),
    ("decision", "decisions"), ("choices", "decisions"), ("success", "success_patterns"),
    ("successful_patterns", "success_patterns"), ("mistake", "mistakes"),
    ("errors", "mistakes"), ("failures", "mistakes"),
]

FALLBACK_CATEGORIES = [row[0] for row in DEFAULT_CATEGORIES]
