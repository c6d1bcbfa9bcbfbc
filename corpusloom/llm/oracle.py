"""DuckDB SQL of the queries that SQL can express on whole tables."""

NAME_KEY = "regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{Nd}}]', '', 'g')"

P1 = f"""
WITH c AS (SELECT {NAME_KEY.format('source')} AS skey, count(DISTINCT id) AS a FROM training_records WHERE id IS NOT NULL GROUP BY 1),
s AS (SELECT name, {NAME_KEY.format('name')} AS skey, coalesce(target_records, 0) AS t, greatest(coalesce(max_repeats, 1), 0)::BIGINT AS m FROM source_specs),
j AS (SELECT s.*, coalesce(c.a, 0) AS a FROM s LEFT JOIN c USING (skey)),
w AS (SELECT sum(a) AS total, sum(t) AS weight FROM j WHERE t > 0),
p AS (SELECT j.*, total, weight, CASE WHEN t > 0 THEN least((2 * total * t + weight) // (2 * weight), a * m) ELSE 0 END AS planned FROM j, w)
"""

ROLE = "CASE lower(trim(coalesce(role, ''))) WHEN 'human' THEN 'user' WHEN 'prompter' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' ELSE lower(trim(coalesce(role, ''))) END"

P6 = f"""
WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY ingested_at DESC) AS n FROM oasst1 WHERE message_id IS NOT NULL),
m AS (SELECT message_id AS id, nullif(trim(coalesce(parent_id, '')), '') AS parent, {ROLE} AS role,
  regexp_matches(coalesce(text, ''), '[^\\t-\\r\\x1c-\\x20\\x{{85}}\\p{{Z}}\\p{{Cc}}\\p{{Cf}}]') AS seen FROM r WHERE n = 1 AND NOT coalesce(deleted, false)),
down AS (
  SELECT id, role, role = 'user' AS good, seen FROM m WHERE parent IS NULL
  UNION ALL
  SELECT c.id, c.role, d.good AND c.role IN ('user', 'assistant') AND c.role <> d.role, d.seen AND c.seen FROM down d JOIN m c ON c.parent = d.id),
lost AS (SELECT id, parent FROM m WHERE id NOT IN (SELECT id FROM down)),
walk AS (
  SELECT id AS start, parent AS here, 1 AS steps FROM lost
  UNION
  SELECT w.start, l.parent, w.steps + 1 FROM walk w JOIN lost l ON l.id = w.here WHERE w.here <> w.start AND w.steps < 200),
ring AS (SELECT DISTINCT start AS id FROM walk WHERE here = start),
leaf AS (SELECT id FROM m WHERE id NOT IN (SELECT parent FROM m WHERE parent IS NOT NULL))
SELECT l.id AS message_id, CASE WHEN d.id IS NULL OR NOT d.good THEN 'broken' WHEN NOT d.seen THEN 'empty' ELSE 'no_reply' END AS reason
FROM leaf l LEFT JOIN down d USING (id) WHERE d.id IS NULL OR NOT d.good OR NOT d.seen OR d.role = 'user'
UNION SELECT id, 'broken' FROM ring
"""


FOLD = "replace(replace(replace(replace(replace(replace(replace(replace(lower(upper(replace({0}, 'ß', 'ss'))), 'ſ', 's'), 'ς', 'σ'), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬆ', 'st')"
FLAT = "regexp_replace(" + FOLD + ", '[\\p{{P}}\\p{{Z}}\\p{{Cc}}\\p{{Cf}}]+', '', 'g')"


def canonical(source: str, segments: str, role: str, content: str) -> str:
    """The canonical text of a record, for comparison."""
    k = f"lower(trim(coalesce({role}, '')))"
    name = f"CASE {k} WHEN 'human' THEN 'user' WHEN 'prompter' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' ELSE {k} END"
    said = FLAT.format(f"coalesce({content}, '')")
    return FLAT.format(f"coalesce({source}, '')") + f" || chr(2) || array_to_string(list_transform(coalesce({segments}, []), lambda s: ({name}) || chr(1) || {said}), chr(3))"


P3 = f"""
WITH raw AS (SELECT raw_id, loaded_at, CASE WHEN json_valid(line) THEN line::JSON END AS j FROM raw_records),
k AS (SELECT 'training_records' AS tbl, id, ingested_at AS arrived, {canonical("source", "segments", "s['role']", "s['content']")} AS k FROM training_records WHERE id IS NOT NULL
  UNION ALL SELECT 'raw_records', raw_id, loaded_at, {canonical("j->>'$.source'", "CASE WHEN json_type(j->'$.segments') = 'ARRAY' THEN (j->'$.segments')::JSON[] END", "s->>'$.role'", "s->>'$.content'")} FROM raw WHERE json_type(j) = 'OBJECT'),
d AS (SELECT tbl, id, min(arrived) AS arrived, min_by(k, arrived) AS k FROM k GROUP BY ALL)
"""

P6_KEPT = P6.split("leaf AS (")[0] + """leaf AS (SELECT id FROM m WHERE id NOT IN (SELECT parent FROM m WHERE parent IS NOT NULL)),
kept AS (SELECT l.id FROM leaf l JOIN down d USING (id) WHERE d.good AND d.seen AND d.role = 'assistant'),
txt AS (SELECT message_id AS id, text, coalesce(rank, 2147483647) AS rank FROM r WHERE n = 1),
path AS (SELECT id AS leaf, id, 0 AS steps FROM kept UNION ALL SELECT p.leaf, m.parent, p.steps + 1 FROM path p JOIN m ON m.id = p.id WHERE m.parent IS NOT NULL)
SELECT p.leaf AS conversation, (max(p.steps) OVER (PARTITION BY p.leaf) - p.steps)::INT AS turn, m.id AS message_id, m.role, t.text AS content, t.rank::INT AS rank
FROM path p JOIN m ON m.id = p.id JOIN txt t ON t.id = p.id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1 + "SELECT name AS source FROM p WHERE t > 0 AND a * m * weight < total * t",
        "p1_shares": P1 + """SELECT name AS source, a AS available, planned::BIGINT AS planned, planned::BIGINT AS copies, least(planned, a)::BIGINT AS used,
            CASE WHEN planned > 0 THEN ((planned + a - 1) // a)::INT ELSE 0 END AS most, round(t / weight, 9) AS target_share,
            round(planned / (SELECT sum(planned) FROM p), 9) AS share FROM p""",
        "p3_found": P3 + ", g AS (SELECT *, min(id) OVER (PARTITION BY tbl, k) AS id_a FROM d) SELECT tbl, id_a, id AS id_b FROM g WHERE id <> id_a",
        "p3_records": P3 + "SELECT tbl, min_by(id, (arrived, id)) AS id, count(*) AS copies FROM d GROUP BY tbl, k",
        "p6_found": P6,
        "p6_turns": P6_KEPT,
    }
