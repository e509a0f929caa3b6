"""Queries of hierarchies and incremental processing, and the list of all core queries."""

from pyspark.sql import functions as F

from corpusloom.operators import hierarchy, incremental
from corpusloom.plans.registry import Q, SQL, query
from corpusloom.session import table

__all__ = ["Q", "SQL"]


_P4 = """WITH RECURSIVE one AS (SELECT conversation_id, node_id, max(parent) AS parent FROM chatgpt_node
    WHERE conversation_id IS NOT NULL AND node_id IS NOT NULL GROUP BY conversation_id, node_id),
up AS (SELECT a.conversation_id, a.node_id, a.parent AS anc FROM one a JOIN one b ON b.conversation_id = a.conversation_id AND b.node_id = a.parent
    UNION SELECT u.conversation_id, u.node_id, a.parent FROM up u JOIN one a ON a.conversation_id = u.conversation_id AND a.node_id = u.anc
    JOIN one b ON b.conversation_id = a.conversation_id AND b.node_id = a.parent)"""


@query("p4_found", _P4 + "\nSELECT DISTINCT conversation_id, node_id FROM up WHERE anc = node_id")
def p4_found(spark, d):
    return hierarchy.cycle_nodes(table(spark, d, "chatgpt_node"), "node_id", "parent", ["conversation_id"], "exported_at")


@query("p4_hierarchy", _P4 + """, dist AS (SELECT conversation_id, node_id, count(*) AS c, bool_or(anc = node_id) AS cyc FROM up GROUP BY ALL),
bad AS (SELECT DISTINCT u.conversation_id, u.node_id FROM up u JOIN dist d ON d.conversation_id = u.conversation_id AND d.node_id = u.anc AND d.cyc),
kin AS (SELECT u.conversation_id, u.anc, count(*) AS c FROM up u WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.conversation_id = u.conversation_id AND b.node_id = u.node_id) GROUP BY ALL),
cur AS (SELECT conversation_id, max(current_node) AS node_id FROM chatgpt_node WHERE current_node IS NOT NULL GROUP BY conversation_id),
way AS (SELECT u.conversation_id, u.node_id, arg_min(u.anc, coalesce(d.c, 0)) AS root, string_agg(u.anc, '/' ORDER BY coalesce(d.c, 0)) AS names FROM up u LEFT JOIN dist d ON d.conversation_id = u.conversation_id AND d.node_id = u.anc GROUP BY ALL)
SELECT o.conversation_id, o.node_id, o.parent, CASE WHEN b.node_id IS NULL THEN coalesce(w.root, o.node_id) END AS root, CASE WHEN b.node_id IS NULL THEN coalesce(d.c, 0) END AS depth,
    CASE WHEN b.node_id IS NULL THEN coalesce(w.names || '/', '') || o.node_id END AS path, CASE WHEN b.node_id IS NULL THEN coalesce(k.c, 0) END AS n_descendants, coalesce(d.cyc, FALSE) AS in_cycle,
    b.node_id IS NOT NULL AND NOT d.cyc AS below_cycle, b.node_id IS NULL AND (c.node_id IS NOT NULL OR EXISTS (SELECT 1 FROM up x JOIN cur ON cur.conversation_id = x.conversation_id AND cur.node_id = x.node_id
        WHERE x.conversation_id = o.conversation_id AND x.anc = o.node_id AND NOT EXISTS (SELECT 1 FROM bad y WHERE y.conversation_id = x.conversation_id AND y.node_id = x.node_id))) AS on_current_branch
FROM one o LEFT JOIN dist d USING (conversation_id, node_id) LEFT JOIN bad b USING (conversation_id, node_id) LEFT JOIN way w USING (conversation_id, node_id)
LEFT JOIN kin k ON k.conversation_id = o.conversation_id AND k.anc = o.node_id LEFT JOIN cur c ON c.conversation_id = o.conversation_id AND c.node_id = o.node_id""")
def p4_hierarchy(spark, d):
    tree = hierarchy.hierarchy(table(spark, d, "chatgpt_node"), "node_id", "parent", ["conversation_id"], "exported_at", "current_node")
    return tree.withColumn("path", F.array_join("path", "/"))


@query("p4_descendants", _P4 + """, n AS (SELECT conversation_id, node_id, count(*) AS c FROM up GROUP BY ALL)
SELECT u.conversation_id, u.anc AS ancestor, u.node_id, CAST(n.c - coalesce(m.c, 0) AS INT) AS distance FROM up u JOIN n ON n.conversation_id = u.conversation_id AND n.node_id = u.node_id
LEFT JOIN n m ON m.conversation_id = u.conversation_id AND m.node_id = u.anc
WHERE NOT EXISTS (SELECT 1 FROM up v JOIN up o ON o.conversation_id = v.conversation_id AND o.node_id = v.anc AND o.anc = o.node_id WHERE v.conversation_id = u.conversation_id AND v.node_id = u.node_id)""")
def p4_descendants(spark, d):
    tree = hierarchy.hierarchy(table(spark, d, "chatgpt_node"), "node_id", "parent", ["conversation_id"], "exported_at")
    return hierarchy.descendants(tree, "node_id", ["conversation_id"])


_P6_FIRST = """first AS (SELECT source_key, wal_sequence, min(received_ms) AS received_ms, min(file_path) AS file_path, min(content_hash) AS content_hash
    FROM wal_record WHERE source_key IS NOT NULL AND wal_sequence IS NOT NULL GROUP BY source_key, wal_sequence),
newest AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY updated_unix_ms DESC, generation DESC NULLS LAST, processed_files DESC NULLS LAST) AS k
    FROM operation_checkpoint),
runs AS (SELECT DISTINCT n.source_key, s.wal_range.first_sequence AS a, s.wal_range.last_sequence AS b, n.updated_unix_ms AS done_ms
    FROM newest n JOIN segment_descriptor s ON s.generation = n.generation AND s.source_key = n.source_key
    WHERE k = 1 AND n.status = 'completed' AND n.processed_files = n.total_files),
before AS (SELECT *, lag(content_hash) OVER (PARTITION BY source_key, file_path ORDER BY wal_sequence) AS prev FROM first)"""


@query("p6_found", f"""WITH {_P6_FIRST}
SELECT source_key, wal_sequence FROM before r
WHERE NOT EXISTS (SELECT 1 FROM runs g WHERE g.source_key = r.source_key AND r.wal_sequence BETWEEN g.a AND g.b AND r.received_ms <= g.done_ms)
  AND NOT coalesce(content_hash = prev AND file_path IS NOT NULL, FALSE)""")
def p6_found(spark, d):
    return incremental.next_batch(*(table(spark, d, t) for t in ("wal_record", "operation_checkpoint", "segment_descriptor"))).select(
        "source_key", "wal_sequence")


@query("p6_low_water", f"""WITH {_P6_FIRST}
SELECT source_key, min(wal_sequence) AS low_sequence FROM first r
WHERE NOT EXISTS (SELECT 1 FROM runs g WHERE g.source_key = r.source_key AND r.wal_sequence BETWEEN g.a AND g.b AND r.received_ms <= g.done_ms)
GROUP BY source_key""")
def p6_low_water(spark, d):
    first = incremental.first_deliveries(table(spark, d, "wal_record"))
    done = incremental.ledger(first, incremental.successful_runs(table(spark, d, "operation_checkpoint"), table(spark, d, "segment_descriptor")))
    return incremental.low_water(first, done).filter("low_sequence is not null").select("source_key", "low_sequence")


from corpusloom.plans import text_queries  # noqa: E402, F401  (they register themselves)
from corpusloom.plans import retrieval_queries  # noqa: E402, F401
from corpusloom.plans import graph_queries  # noqa: E402, F401
from corpusloom.plans import upkeep_queries  # noqa: E402, F401
from corpusloom.plans import ranking_queries  # noqa: E402, F401
from corpusloom.plans import answer_queries  # noqa: E402, F401
from corpusloom.plans import learning_queries  # noqa: E402, F401
from corpusloom.plans import detail_queries  # noqa: E402, F401
from corpusloom.plans import learned_queries  # noqa: E402, F401
