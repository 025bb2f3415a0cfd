"""Agent-memory tables derived from the driver's tables.

``VIEWS`` holds SQL that means the same in Spark and in the oracle engine. Some views cut their base table (text behind the
first full stop, system turns, error events): see Open in the README. ``Tables`` serves base tables and views as DataFrames and adds the typed columns the operators take.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

AS_OF = 1722470400  # 2024-08-01 00:00 UTC

VIEWS = {
    "memories": """
SELECT d.doc_id AS id,
  d.text AS content,
  split_part(d.text, '.', 1) AS l0_abstract,
  CASE d.doc_id % 9 WHEN 0 THEN 'preferences' WHEN 1 THEN 'identity' WHEN 2 THEN 'emotional'
    WHEN 3 THEN 'project' WHEN 4 THEN 'work' WHEN 5 THEN 'lessons_learned'
    WHEN 6 THEN 'decisions' WHEN 7 THEN 'success_patterns' ELSE 'mistakes' END AS category,
  CASE WHEN d.doc_id % 10 = 0 THEN 'pinned' WHEN d.doc_id % 10 < 8 THEN 'insight' ELSE 'session' END AS memory_type,
  CASE WHEN d.doc_id % 17 = 0 THEN 'archived' ELSE 'active' END AS state,
  CASE WHEN d.doc_id % 5 = 0 THEN 'core' WHEN d.doc_id % 5 < 3 THEN 'working' ELSE 'peripheral' END AS tier,
  CAST((d.doc_id * 7) % 101 AS DOUBLE) / 100 AS importance,
  CAST((d.doc_id * 13) % 101 AS DOUBLE) / 100 AS confidence,
  CAST(d.doc_id % 16 AS INT) AS access_count,
  concat('tenant-', CAST(d.doc_id % 3 AS STRING)) AS tenant_id,
  concat('agent-', CAST(d.doc_id % 5 AS STRING)) AS owner_agent_id,
  concat('sess-', CAST(d.doc_id % 40 AS STRING)) AS session_id,
  CASE d.doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN concat('personal/tenant-', CAST(d.doc_id % 3 AS STRING))
    WHEN 2 THEN 'team/t1' ELSE 'org/o1' END AS space_id,
  CASE WHEN d.doc_id % 7 = 0 THEN 'private' WHEN d.doc_id % 7 = 1 THEN 'shared:team/t1' ELSE 'global' END AS visibility,
  CASE WHEN d.doc_id % 7 = 0 THEN 'private' ELSE 'global' END AS scope,
  CASE WHEN d.doc_id % 7 = 0 THEN NULL WHEN d.doc_id % 6 = 0 THEN NULL WHEN d.doc_id % 6 = 1 THEN '/srv'
    WHEN d.doc_id % 6 < 4 THEN '/srv/app' WHEN d.doc_id % 6 = 4 THEN '/srv/app/web' ELSE '/opt/other' END AS project_path,
  CASE WHEN d.doc_id % 11 = 0 THEN 'session_ingest' WHEN d.doc_id % 11 < 6 THEN 'ingest' ELSE NULL END AS source,
  CAST(1 + d.doc_id % 4 AS BIGINT) AS version,
  CASE WHEN d.doc_id % 23 = 0 THEN d.doc_id + 1 ELSE NULL END AS superseded_by,
  CASE WHEN d.doc_id % 8 = 3 THEN d.doc_id - 1 ELSE NULL END AS shared_from_memory,
  CASE WHEN d.doc_id % 8 = 3 THEN CAST(1 + d.doc_id % 2 AS BIGINT) ELSE NULL END AS source_version,
  1704067200 + ((d.doc_id * 37) % 180) * 86400 AS created_s,
  CASE WHEN d.doc_id % 3 = 0 THEN NULL
    ELSE 1704067200 + ((d.doc_id * 37) % 180) * 86400 + ((d.doc_id * 11) % 30) * 86400 END AS last_accessed_s,
  d.doc_id % (SELECT count(*) FROM embeddings) AS vec_id,
  d.lang AS lang_tag, d.source AS source_tag
FROM documents d""",
    "memory_tags": """
SELECT id, lang_tag AS tag FROM memories
UNION ALL SELECT id, source_tag AS tag FROM memories
UNION ALL SELECT id, 'hot' AS tag FROM memories WHERE tier = 'core'""",
    "memory_relations": """
SELECT id AS src_id, CASE category WHEN 'project' THEN 'contextualizes' WHEN 'work' THEN 'contradicts' ELSE 'supports' END AS relation_type,
  (id * 3 + 1) % (SELECT count(*) + 7 FROM documents) AS target_id FROM memories
UNION ALL SELECT a.doc_id, 'continued_by', b.doc_id FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 AND b.lang = a.lang
UNION ALL SELECT b.doc_id, 'continues', a.doc_id FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 AND b.lang = a.lang""",
    "memory_queries": """
SELECT item_id AS query_id, text AS query_text,
  (item_id * 7) % (SELECT count(*) FROM embeddings) AS query_vec_id,
  concat('tenant-', CAST(item_id % 3 AS STRING)) AS tenant_id,
  concat('agent-', CAST(item_id % 5 AS STRING)) AS agent_id,
  CASE WHEN item_id % 2 = 0 THEN '/srv/app' ELSE NULL END AS project_path,
  CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'hot' ELSE NULL END AS query_tag FROM benchmark""",
    "session_messages": """
SELECT concat('sess-', CAST(conv_id % 40 AS STRING)) AS session_id, conv_id, turn, role, text AS content,
  concat('agent-', CAST(conv_id % 5 AS STRING)) AS agent_id,
  1717200000 + conv_id * 600 + turn * 20 AS created_s FROM conversations""",
    "facts": """
SELECT conv_id * 100 + turn AS fact_id, conv_id AS batch_id, turn AS fact_index, split_part(text, '.', 1) AS l0_abstract, text AS l2_content,
  CASE conv_id % 4 WHEN 0 THEN 'likes' WHEN 1 THEN ' Project ' WHEN 2 THEN 'decisions' ELSE 'unlisted' END AS category,
  CAST(turn % 6 AS INT) AS llm_confidence, concat('tenant-', CAST(conv_id % 3 AS STRING)) AS tenant_id,
  concat('sess-', CAST(conv_id % 40 AS STRING)) AS session_id,
  (conv_id * 11 + turn) % (SELECT count(*) FROM embeddings) AS vec_id FROM conversations""",
    "decisions": """
SELECT batch_id, fact_index, fact_id,
  CASE fact_id % 8 WHEN 0 THEN 'create' WHEN 1 THEN 'MERGE' WHEN 2 THEN 'SKIP' WHEN 3 THEN 'SUPERSEDE'
    WHEN 4 THEN 'SUPPORT' WHEN 5 THEN 'CONTEXTUALIZE' WHEN 6 THEN 'CONTRADICT' ELSE 'other' END AS action,
  (batch_id * 13 + fact_index * 5) % (SELECT count(*) FROM documents) AS match_id,
  CASE WHEN fact_id % 3 = 0 THEN concat('merged ', l0_abstract) ELSE NULL END AS merged_content FROM facts""",
    "spaces": """
SELECT 'team/t1' AS space_id, 'team' AS space_type, 'tenant-0' AS owner_id
UNION ALL SELECT 'org/o1', 'organization', 'tenant-1'
UNION ALL SELECT 'personal/tenant-0', 'personal', 'tenant-0'
UNION ALL SELECT 'personal/tenant-1', 'personal', 'tenant-1'
UNION ALL SELECT 'personal/tenant-2', 'personal', 'tenant-2'""",
    "space_members": """
SELECT 'team/t1' AS space_id, 'tenant-0' AS user_id, 'admin' AS role
UNION ALL SELECT 'team/t1', 'tenant-1', 'member' UNION ALL SELECT 'org/o1', 'tenant-1', 'admin'
UNION ALL SELECT 'org/o1', 'tenant-0', 'reader' UNION ALL SELECT 'org/o1', 'tenant-2', 'reader'""",
    "share_rules": """
SELECT 1 AS rule_id, 'team/t1' AS space_id, 'personal/tenant-0' AS source_space, 'decisions' AS category, CAST(NULL AS STRING) AS tag, CAST(0.3 AS DOUBLE) AS min_importance, FALSE AS require_approval
UNION ALL SELECT 2, 'team/t1', 'personal/tenant-1', NULL, 'hot', 0.5, FALSE
UNION ALL SELECT 3, 'team/t1', 'personal/tenant-1', NULL, NULL, 0.6, FALSE
UNION ALL SELECT 4, 'org/o1', 'personal/tenant-1', NULL, NULL, 0.8, FALSE
UNION ALL SELECT 5, 'org/o1', 'personal/tenant-0', NULL, NULL, 0.0, TRUE""",
    "sharing_events": """
SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'share' WHEN 'view' THEN 'pull' WHEN 'purchase' THEN 'batch_share'
    WHEN 'signup' THEN 'reshare' ELSE 'unshare' END AS action,
  event_id % (SELECT count(*) FROM documents) AS memory_id,
  CASE WHEN user_id % 2 = 0 THEN 'personal/tenant-0' ELSE 'personal/tenant-1' END AS from_space,
  CASE WHEN event_id % 3 = 0 THEN 'org/o1' ELSE 'team/t1' END AS to_space,
  concat('tenant-', CAST(user_id % 3 AS STRING)) AS user_id, concat('agent-', CAST(user_id % 5 AS STRING)) AS agent_id, ts FROM events""",
    "recall_events": """
SELECT event_id, concat('sess-', CAST(user_id AS STRING)) AS session_id,
  CASE WHEN event_type IN ('click', 'view') THEN 'auto' WHEN event_type = 'purchase' THEN 'manual' ELSE 'other' END AS recall_type,
  concat('q', CAST(event_id AS STRING)) AS query_text, concat('tenant-', CAST(user_id % 3 AS STRING)) AS tenant_id, ts FROM events""",
    "recall_items": """
SELECT event_id * 2 AS item_id, event_id, (event_id * 3) % (SELECT count(*) FROM documents) AS memory_id,
  CAST(event_id % 100 AS DOUBLE) / 100 AS score, event_id % 4 <> 0 AS is_kept FROM events
UNION ALL SELECT event_id * 2 + 1, event_id, (event_id * 7 + 1) % (SELECT count(*) FROM documents), CAST(event_id % 37 AS DOUBLE) / 100, TRUE FROM events WHERE event_type = 'view'""",
    "preferences": """
SELECT doc_id AS id, concat('tenant-', CAST(doc_id % 3 AS STRING)) AS tenant_id,
  CASE doc_id % 5 WHEN 0 THEN 'tone' WHEN 1 THEN 'language' WHEN 2 THEN 'code_style' WHEN 3 THEN 'custom:editor' ELSE 'preferred_tools' END AS slot,
  split_part(text, '.', 1) AS value, CAST((doc_id * 17) % 96 AS DOUBLE) / 100 AS confidence,
  CASE WHEN doc_id % 3 = 0 THEN 'project' ELSE 'global' END AS scope, CASE WHEN doc_id % 3 = 0 THEN '/srv/app' ELSE NULL END AS project_path,
  CASE doc_id % 7 WHEN 0 THEN 'dormant' WHEN 1 THEN 'reinforce' WHEN 2 THEN 'deleted' ELSE 'active' END AS status,
  1704067200 + (doc_id % 210) * 86400 AS reinforced_s FROM documents""",
    "vectors": "SELECT vec_id, embedding FROM embeddings",
}


class Tables:
    """DataFrames of one scale-factor folder, by attribute name."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._built:
            self._built[name] = self._build(name)
        return self._built[name]

    def _build(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.path}/{name}.parquet")
        if name == "memory":
            return self._memory()
        if name == "memory_vectors":
            vectors = self.embeddings.select("vec_id", "embedding")
            return self.memories.select("id", "vec_id").join(vectors, "vec_id").select("id", "embedding")
        if name not in VIEWS:
            raise AttributeError(name)
        named: dict[str, DataFrame] = {}

        def bind(match: re.Match) -> str:
            table = match.group(2)
            if table not in BASE and table not in VIEWS:
                return match.group(0)
            named[table] = getattr(self, table)
            return f"{match.group(1)}{{{table}}}"

        text = re.sub(r"\b((?:FROM|JOIN)\s+)(\w+)", bind, VIEWS[name])
        return self.spark.sql(text, **named) if named else self.spark.sql(text)

    def _memory(self) -> DataFrame:
        """``memories`` with tags as array and times as timestamps."""
        return self.memories.select(
            "*",
            F.array_compact(F.array(
                "lang_tag", "source_tag", F.when(F.col("tier") == "core", F.lit("hot"))
            )).alias("tags"),
            F.timestamp_seconds("created_s").alias("created_at"),
            F.timestamp_seconds("created_s").alias("updated_at"),
            F.timestamp_seconds("last_accessed_s").alias("last_accessed_at"),
        )
