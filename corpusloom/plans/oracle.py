"""DuckDB SQL of the core queries, over the same tables.

Only `reasoning_examples`, whose rows are drawn by Spark's own hash, has no entry; a
test solves its tasks again.
"""

from __future__ import annotations

from corpusloom.operators.quality import BAD_ASSISTANT_PHRASES, BAD_PROMPT_PHRASES, GENERIC_PROMPTS
from corpusloom.operators.vocabulary import ASCII_FALLBACK, COMMON_PUNCTUATION
from corpusloom.schema import SPECIAL_TOKENS

SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def role(c: str) -> str:
    k = rf"lower(regexp_replace(coalesce({c}, ''), '^{SPACE}+|{SPACE}+$', '', 'g'))"
    return f"CASE {k} WHEN 'human' THEN 'user' WHEN 'prompter' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' ELSE {k} END"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def flat(c: str) -> str:
    return rf"trim(regexp_replace({c}, '{SPACE}+', ' ', 'g'))"


def key(c: str) -> str:
    return rf"regexp_replace(lower(coalesce({c}, '')), '[^\p{{L}}\p{{Nd}}]', '', 'g')"


def newlines(c: str) -> str:
    return rf"regexp_replace({c}, '\r\n?', chr(10), 'g')"


TURNS = f"""
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at) AS rn FROM training_records WHERE id IS NOT NULL) WHERE rn = 1),
seg AS (SELECT id, source, unnest(segments) AS s, generate_subscripts(segments, 1) AS pos FROM d),
cleaned AS (SELECT id, {key('source')} AS source, pos, {role("s['role']")} AS role, {flat("nfc_normalize(coalesce(s['content'], ''))")} AS content FROM seg),
kept AS (SELECT * FROM cleaned WHERE role IN ('system', 'user', 'assistant') AND content <> ''),
mark AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY id ORDER BY pos) = role THEN 0 ELSE 1 END AS fresh FROM kept),
isle AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY pos) - 1 AS turn FROM mark),
turns AS (SELECT id, source, turn::INT AS turn, role, string_agg(content, chr(10) ORDER BY pos) AS content FROM isle GROUP BY ALL)
"""

#: Shown windows from (id, t: target turn, lo: first turn).
SHOW = """
SELECT w.id, w.t AS turn, {extra} count(*)::INT AS n,
  sha256(string_agg(x.role || ':' || x.content || ':' || CASE WHEN x.turn = w.t AND x.role = 'assistant' THEN '1' ELSE '0' END, '|' ORDER BY x.turn)) AS digest
FROM w JOIN turns x ON x.id = w.id AND x.turn BETWEEN w.lo AND w.t GROUP BY ALL
"""

PREFIX = """
w AS (SELECT a.id, a.source, a.turn AS t, 0 AS lo FROM turns a WHERE a.role = 'assistant'
  AND EXISTS (SELECT 1 FROM turns u WHERE u.id = a.id AND u.turn < a.turn AND u.role = 'user') {bound})
"""
BOUND_8 = "AND (SELECT count(*) FROM turns u WHERE u.id = a.id AND u.turn <= a.turn AND u.role IN ('user', 'assistant')) <= 8"

#: Context windows: the first turn that isn't an assistant's within the last `size` turns.
CONTEXT = """
sizes AS (SELECT unnest({sizes}) AS size),
w AS (SELECT a.id, a.turn AS t, size, (SELECT min(u.turn) FROM turns u WHERE u.id = a.id AND u.turn > a.turn - size AND u.turn <= a.turn AND u.role <> 'assistant') AS lo
  FROM turns a, sizes WHERE a.role = 'assistant')
"""

RENDERED = "CASE x.role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' ELSE 'Assistant' END || ': ' || x.content || chr(10)"
TARGET = "x.turn = w.t AND x.role = 'assistant'"


def windows(reason: str, extra: str = "") -> str:
    phrases = " OR ".join(f"contains(p.prompt, '{x}')" for x in BAD_PROMPT_PHRASES)
    generic = ", ".join(f"'{x}'" for x in GENERIC_PROMPTS)
    lower_flat = flat("lower(x.content)")
    return f"""
WITH {TURNS}, {PREFIX.format(bound=BOUND_8)},
p AS (SELECT w.id, w.source, w.t AS turn,
  coalesce(string_agg(x.role || ':' || {lower_flat}, chr(10) ORDER BY x.turn) FILTER (WHERE NOT ({TARGET})), '') AS prompt,
  {strip(f"string_agg({RENDERED}, '' ORDER BY x.turn)")} AS record,
  {strip(f"coalesce(string_agg({RENDERED}, '' ORDER BY x.turn) FILTER (WHERE NOT ({TARGET})), '')")} AS asked,
  {strip(f"coalesce(string_agg({RENDERED}, '' ORDER BY x.turn) FILTER (WHERE {TARGET}), '')")} AS answer,
  coalesce(max_by({lower_flat}, x.turn) FILTER (WHERE x.role = 'user'), '') AS last_user,
  max(x.content) FILTER (WHERE {TARGET}) AS said, list(x.content) AS parts
  FROM w JOIN turns x ON x.id = w.id AND x.turn BETWEEN w.lo AND w.t GROUP BY ALL),
{extra}
r AS (SELECT p.*, ({phrases}) OR last_user IN ({generic}) AS bad, sha256(prompt) AS prompt_hash,
  len(regexp_extract_all(record, '\\p{{L}}')) AS letters, len(regexp_extract_all(record, '[A-Za-z]')) AS latin FROM p),
v AS (SELECT *, {reason} AS reason FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY id, turn) AS ord FROM v),
f AS (SELECT *, min(CASE WHEN reason = 'ok' THEN ord END) OVER (PARTITION BY prompt_hash) AS fv FROM o),
st AS (SELECT *, CASE WHEN ord = fv THEN 'accepted' WHEN fv IS NULL OR ord < fv THEN 'skipped' ELSE 'duplicate' END AS status FROM f)
"""


QUALITY = windows(
    "CASE WHEN bad THEN 'bad_prompt' WHEN length(record) > 2000 THEN 'too_long_record_chars' WHEN length(asked) > 1200 THEN 'too_long_prompt_chars' "
    "WHEN length(answer) > 600 THEN 'too_long_response_chars' WHEN letters >= 8 AND latin / letters < 0.6 THEN 'non_english' ELSE 'ok' END"
)
DAILY = windows("CASE WHEN length(record) > 900 THEN 'too_long_record_chars' WHEN length(answer) > 400 THEN 'too_long_response_chars' ELSE 'ok' END")
_CJK = "len(regexp_extract_all(c, '[\\x{4e00}-\\x{9fff}]'))"
_LINK = "regexp_matches(c, '(?i)https?://|www\\.|@')"
CHINESE = windows(
    "CASE WHEN list_bool_or(list_transform(parts, lambda c: NOT (len(regexp_extract_all(c, '[A-Za-z]')) <= 24 AND "
    + f"{_CJK} >= 2 AND {_CJK} / ({_CJK} + len(regexp_extract_all(c, '[A-Za-z0-9]'))) >= 0.6 AND NOT {_LINK}))) THEN 'non_chinese' "
    "WHEN length(record) < 20 THEN 'too_short_record_chars' WHEN length(record) > 900 THEN 'too_long_record_chars' "
    "WHEN length(answer) < 12 THEN 'too_short_response_chars' WHEN length(answer) > 300 THEN 'too_long_response_chars' ELSE 'ok' END"
)

LATEST = "m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY ingested_at DESC) AS rn FROM oasst1) WHERE rn = 1)"
MESSAGE_OK = (
    f"lang = 'en' AND NOT coalesce(deleted, false) AND coalesce(review_result, true) AND coalesce(detoxify['toxicity'] <= 0.5, true) "
    f"AND {role('role')} IN ('user', 'assistant') AND coalesce({strip('text')} <> '', false)"
)


LOGIC = windows(
    "CASE WHEN list_bool_or(list_transform(parts, lambda c: NOT (len(regexp_extract_all(c, '[A-Za-z]')) <= 60 AND "
    + f"{_CJK} >= 2 AND {_CJK} / ({_CJK} + len(regexp_extract_all(c, '[A-Za-z0-9]'))) >= 0.5))) THEN 'non_chinese' "
    "WHEN length(record) < 20 THEN 'too_short_record_chars' WHEN length(record) > 900 THEN 'too_long_record_chars' "
    "WHEN length(said) < 16 THEN 'too_short_response_chars' WHEN length(said) > 90 THEN 'too_long_response_chars' ELSE 'ok' END"
)

HAN = r"[\x{4e00}-\x{9fff}]"
ENGLISH = "[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


FIXED_TOKENS = ", ".join(f"({i}, {quoted(t)})" for i, t in enumerate(dict.fromkeys([*SPECIAL_TOKENS, *ASCII_FALLBACK, *COMMON_PUNCTUATION])))
#: Words and Han characters of the documents with counts and first places, and the vocabulary cut from them.
VOCABULARY = f"""
vt AS (SELECT doc_id, lower(nfc_normalize(coalesce(text, ''))) AS t FROM documents),
vw AS (SELECT 'word' AS kind, doc_id, unnest(regexp_extract_all(t, '{ENGLISH}')) AS token, generate_subscripts(regexp_extract_all(t, '{ENGLISH}'), 1) AS p FROM vt
  UNION ALL SELECT 'cjk', doc_id, unnest(regexp_extract_all(t, '{HAN}')), generate_subscripts(regexp_extract_all(t, '{HAN}'), 1) FROM vt),
vc AS (SELECT kind, token, count(*) AS n, min((doc_id, p)) AS first FROM vw GROUP BY ALL),
vboth AS (SELECT token, first FROM vc UNION ALL SELECT '##' || right(token, 3), first FROM vc WHERE length(token) > 4),
vone AS (SELECT token, min(first) AS first FROM vboth GROUP BY token),
vsrc AS (SELECT token, row_number() OVER (ORDER BY first, token) - 1 AS ord FROM vone),
vbase AS (SELECT * FROM (VALUES {FIXED_TOKENS}) AS x(ord, token)),
vfresh AS (SELECT *, CASE WHEN regexp_full_match(token, '{HAN}') THEN 'cjk' WHEN regexp_matches(token, '^##[A-Za-z0-9'']+$') THEN 'piece'
    WHEN regexp_matches(token, '^[A-Za-z0-9'']+$') AND regexp_matches(token, '[A-Za-z]') THEN 'word' END AS kind FROM vsrc WHERE token NOT IN (SELECT token FROM vbase)),
vcount AS (SELECT kind, token, row_number() OVER (PARTITION BY kind ORDER BY n DESC, first, token) AS ord FROM vc WHERE token IN (SELECT token FROM vfresh)),
vall AS (SELECT 0 AS stage, ord, token FROM vbase
  UNION ALL SELECT 1, ord, token FROM vcount WHERE kind = 'cjk' AND ord <= 300 UNION ALL SELECT 2, ord, token FROM vcount WHERE kind = 'word' AND ord <= 500
  UNION ALL SELECT 3, ord, token FROM (SELECT token, row_number() OVER (ORDER BY ord, token) AS ord FROM vfresh WHERE kind = 'piece') WHERE ord <= 100
  UNION ALL SELECT 5, ord, token FROM vfresh WHERE starts_with(token, '##') OR regexp_matches(token, '{HAN}') OR regexp_matches(token, '^[A-Za-z0-9'']+$') OR length(token) = 1),
vmin AS (SELECT token, min((stage, ord)) AS place FROM vall GROUP BY token),
vocabulary AS (SELECT row_number() OVER (ORDER BY place, token) - 1 AS id, token FROM vmin QUALIFY id < 1200)
"""


def token_counts(texts: str) -> str:
    """CTEs that count the tokens of the distinct texts of `texts` (t) into `tokens_of` (t, n)."""
    return f"""
tx AS (SELECT t, lower(nfc_normalize(t)) AS low FROM (SELECT DISTINCT t FROM {texts})),
tw AS (SELECT t, unnest(regexp_extract_all(low, '{ENGLISH}')) AS word FROM tx),
words AS (SELECT DISTINCT word FROM tw),
wpos AS (SELECT word, unnest(generate_series(1, length(word))) AS pos FROM words WHERE length(word) <= 100),
wcand AS (SELECT word, pos, unnest(generate_series(1, least(length(word) - pos + 1, (SELECT max(length(token)) FROM vocabulary)))) AS len FROM wpos),
wbest AS (SELECT word, pos, max(len) AS len FROM wcand JOIN vocabulary v ON v.token = CASE WHEN pos > 1 THEN '##' ELSE '' END || substr(word, pos, len) GROUP BY ALL),
wwalk AS (SELECT word, 1::BIGINT AS pos, 0 AS n FROM words WHERE length(word) <= 100 UNION ALL SELECT w.word, w.pos + b.len, w.n + 1 FROM wwalk w JOIN wbest b ON b.word = w.word AND b.pos = w.pos),
wn AS (SELECT words.word, coalesce(max(w.n), length(words.word)) AS n FROM words LEFT JOIN wwalk w ON w.word = words.word AND w.pos = length(words.word) + 1 GROUP BY words.word),
tn AS (SELECT t, sum(n) AS n FROM tw JOIN wn USING (word) GROUP BY t),
tokens_of AS (SELECT tx.t, (length(regexp_replace(low, '{ENGLISH}', '', 'g')) + coalesce(tn.n, 0))::INT AS n FROM tx LEFT JOIN tn USING (t))
"""


#: Rendered segments of the dialogues of two segments or more with their token counts, and the packed records.
PACKED = f"""
{TURNS}, {VOCABULARY},
many AS (SELECT id FROM turns GROUP BY id HAVING count(*) > 1),
said AS (SELECT x.id, x.turn, x.role = 'assistant' AS trained, {RENDERED} AS t FROM turns x JOIN many USING (id)),
{token_counts('said')},
runs AS (SELECT id, turn, trained, n, (1 + sum(n) OVER (PARTITION BY id ORDER BY turn) - n)::INT AS a FROM said JOIN tokens_of USING (t)),
ends AS (SELECT id, max(a + n) AS total, max_by(trained, turn) AS last FROM runs GROUP BY id),
packed AS (SELECT id, (total + 1)::INT AS n, ((SELECT coalesce(sum(r.n), 0) FROM runs r WHERE r.id = e.id AND r.trained) + last::INT)::BIGINT AS weight FROM ends e)
"""


def trimmed(turns: str, max_turns: int, max_chars: int) -> str:
    """CTEs of the segments of `turns` (id, turn, role, content) that a budget leaves, in `trimmed`."""
    over = f"b.used + length(t.content) > {max_chars}"
    stop = f"(b.stop OR (t.role IN ('user', 'assistant') AND b.n >= {max_turns}) OR ({over} AND b.kept > 0))"
    add = f"(NOT {stop} AND NOT ({over}))"
    return f"""
bud AS (SELECT id, -1 AS i, 0::BIGINT AS used, 0 AS n, false AS stop, 0 AS kept, false AS added FROM {turns} GROUP BY id
  UNION ALL SELECT b.id, t.turn, b.used + CASE WHEN {add} THEN length(t.content) ELSE 0 END, b.n + CASE WHEN {add} AND t.role IN ('user', 'assistant') THEN 1 ELSE 0 END, {stop}, b.kept + {add}::INT, {add}
  FROM bud b JOIN {turns} t ON t.id = b.id AND t.turn = b.i + 1),
held AS (SELECT t.* FROM {turns} t JOIN bud b ON b.id = t.id AND b.i = t.turn AND b.added),
bounds AS (SELECT id, max(turn) FILTER (WHERE role = 'assistant') AS z FROM held GROUP BY id),
heads AS (SELECT h.id, min(turn) FILTER (WHERE role <> 'assistant') AS a, max(z) AS z FROM held h JOIN bounds USING (id) WHERE turn <= z GROUP BY h.id),
trimmed AS (SELECT h.* FROM held h JOIN heads USING (id) WHERE turn BETWEEN a AND z)
"""


def draw(seed: int, c: str, below: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || ({c})::VARCHAR), 1, 15))::BIGINT % ({below}))"


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["dialog_segments"] = f"""WITH {TURNS} SELECT d.id, {key('d.source')} AS source, count(t.id)::INT AS n, count(t.id) FILTER (WHERE t.role <> 'system')::INT AS turns,
        sha256(coalesce(string_agg(t.role || ':' || t.content, '|' ORDER BY t.turn), '')) AS digest FROM d LEFT JOIN turns t USING (id) GROUP BY d.id, d.source"""
    sql["prefix_windows"] = f"WITH {TURNS}, {PREFIX.format(bound=BOUND_8)} " + SHOW.format(extra="")
    sql["context_windows_2_4_6"] = f"WITH {TURNS}, {CONTEXT.format(sizes='[2, 4, 6]')} " + SHOW.format(extra="w.size AS size,") .replace("GROUP BY ALL", "WHERE w.lo IS NOT NULL GROUP BY ALL")
    sql["sliding_window_3"] = f"WITH {TURNS}, {CONTEXT.format(sizes='[3]')} " + SHOW.format(extra="").replace("GROUP BY ALL", "WHERE w.lo IS NOT NULL GROUP BY ALL")
    sql["single_turn_pairs"] = f"""WITH {TURNS}, w AS (SELECT a.id, a.turn AS t, a.turn - 1 AS lo FROM turns a JOIN turns u ON u.id = a.id AND u.turn = a.turn - 1 AND u.role = 'user' WHERE a.role = 'assistant')
        """ + SHOW.format(extra="")
    sql["short_dialogs"] = f"""WITH {TURNS}, {CONTEXT.format(sizes='[3]')},
        p AS (SELECT w.id, w.t AS turn, count(*) FILTER (WHERE x.role <> 'system') AS k, bool_or(x.role = 'user') AS u, length({strip(f"string_agg({RENDERED}, '' ORDER BY x.turn)")}) AS total,
          length({strip(f"coalesce(string_agg({RENDERED}, '' ORDER BY x.turn) FILTER (WHERE {TARGET}), '')")}) AS target, max(length(x.content)) FILTER (WHERE x.role = 'assistant') AS longest
          FROM w JOIN turns x ON x.id = w.id AND x.turn BETWEEN w.lo AND w.t WHERE w.lo IS NOT NULL GROUP BY ALL)
        SELECT id, turn, k >= 2 AND u AND total <= 900 AND target BETWEEN 1 AND 300 AND longest <= 300 AS ok FROM p"""
    sql["full_dialog"] = f"""WITH {TURNS},
        s AS (SELECT id, coalesce(min(turn) FILTER (WHERE role <> 'system'), 1000000) AS n FROM turns GROUP BY id),
        rest AS (SELECT t.*, row_number() OVER (PARTITION BY t.id ORDER BY turn) - 1 AS i FROM turns t JOIN s USING (id) WHERE turn >= n AND role <> 'system'),
        b AS (SELECT id, min(i) FILTER (WHERE role = 'user') AS a, max(i) FILTER (WHERE role = 'assistant') AS z FROM rest GROUP BY id),
        body AS (SELECT r.id, r.turn, r.role, r.content, z - a AS last FROM rest r JOIN b USING (id) WHERE r.i BETWEEN a AND z AND z > a),
        whole AS (SELECT * FROM body UNION ALL SELECT t.id, t.turn, t.role, t.content, (SELECT max(last) FROM body y WHERE y.id = t.id) FROM turns t JOIN s USING (id) WHERE t.turn < n AND t.id IN (SELECT id FROM body))
        SELECT id, last::INT AS turn, count(*)::INT AS n, sha256(string_agg(role || ':' || content || ':' || CASE WHEN role = 'assistant' THEN '1' ELSE '0' END, '|' ORDER BY turn)) AS digest FROM whole GROUP BY id, last"""
    sql["prompt_dedup_first_valid"] = QUALITY + "SELECT id, turn, prompt_hash, reason, status FROM st"
    sql["dedup_counters"] = QUALITY + """SELECT source, count(DISTINCT id) AS scanned, count(*) AS candidates, count(*) FILTER (WHERE status = 'accepted') AS written,
        count(*) FILTER (WHERE status = 'duplicate') AS duplicates, count(*) FILTER (WHERE status = 'skipped') AS skipped FROM st GROUP BY source"""
    skipped = "count(*) AS n FROM st WHERE status = 'skipped' GROUP BY ALL"
    sql["skip_reason_hist"] = QUALITY + f"SELECT source, reason, {skipped}"
    for name, cte in (("daily", DAILY), ("chinese", CHINESE), ("logic", LOGIC)):
        sql[f"{name}_reason_hist"] = cte + f"SELECT reason, {skipped}"
    sql["source_quota"] = QUALITY + "SELECT source, id, turn, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id, turn) AS rank FROM st WHERE status = 'accepted') WHERE rank <= 20"
    fold = QUALITY
    seen = ""
    names = (("worldtalk", 40), ("smalltalkzh", 1000), ("orchardpairs", 25), ("rest", 1_000_000))
    for name, quota in names:
        own = f"source = '{name}'" if name != "rest" else "source NOT IN ('worldtalk', 'smalltalkzh', 'lanternchat', 'orchardpairs')"
        fold += f""", n_{name} AS (SELECT * FROM o WHERE {own} AND reason = 'ok' {seen}),
        g_{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prompt_hash ORDER BY id, turn) AS k FROM n_{name}) WHERE k = 1),
        q_{name} AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY id, turn) AS rank FROM g_{name}) WHERE rank <= {quota})"""
        seen += f" AND prompt_hash NOT IN (SELECT prompt_hash FROM q_{name})"
    sql["merge_fold"] = fold + " UNION ALL ".join(f"SELECT '{n}' AS source_name, id, turn, rank::INT AS rank FROM q_{n}" for n, _ in names)
    sql["english_ratio"] = """WITH c AS (SELECT doc_id, text, len(regexp_extract_all(text, '\\p{L}')) AS l, len(regexp_extract_all(text, '[A-Za-z]')) AS a FROM documents)
        SELECT doc_id, CASE WHEN l > 0 THEN round(a / l, 6) END AS ratio, CASE WHEN l < 8 THEN true ELSE a / l >= 0.7 END AS is_english FROM c"""
    sql["cjk_ratio"] = """WITH c AS (SELECT doc_id, text, len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]')) AS k, len(regexp_extract_all(text, '[A-Za-z0-9]')) AS a FROM documents)
        SELECT doc_id, k::INT AS cjk, CASE WHEN k + a > 0 THEN round(k / (k + a), 6) ELSE 0.0 END AS ratio FROM c"""
    sql["bad_prompts"] = windows("'ok'").replace(BOUND_8, "") + "SELECT id, turn, bad FROM r"
    sql["language_gate"] = "SELECT doc_id, lang IS NULL OR lang = '' OR lower(lang) IN ('en', 'english') AS ok FROM documents"
    sql["message_filter"] = f"SELECT message_id, ingested_at FROM oasst1 WHERE {MESSAGE_OK}"
    sql["text_records"] = f"""WITH t AS (SELECT doc_id, {strip(newlines('nfc_normalize(text)'))} AS text FROM documents), c AS (SELECT doc_id, regexp_replace(substr(text, 1, 6000), '{SPACE}+$', '') AS text FROM t WHERE length(text) >= 100)
        SELECT doc_id, length(text)::INT AS chars, sha256(text) AS digest FROM c"""
    sql["char_budget"] = f"""WITH u AS (SELECT doc_id, {strip(newlines('nfc_normalize(text)'))} AS text FROM documents WHERE length({strip(newlines('nfc_normalize(text)'))}) >= 1),
        s AS (SELECT *, length(text) AS n, sum(length(text)) OVER (ORDER BY doc_id) AS e FROM u), f AS (SELECT min(doc_id) AS stop FROM s WHERE e > 50000)
        SELECT doc_id, (CASE WHEN stop IS NULL OR doc_id < stop THEN n ELSE 50000 - (e - n) END)::INT AS chars, NOT (stop IS NULL OR doc_id < stop) AS cut, CASE WHEN NOT (stop IS NULL OR doc_id < stop) THEN 'lm' END AS task FROM s, f
        WHERE stop IS NULL OR doc_id < stop OR (doc_id = stop AND e - n < 50000)"""
    sql["word_freq_topk"] = f"""WITH {VOCABULARY}, r AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, first, kind) AS rank FROM vc)
        SELECT token, n, rank::INT AS rank FROM r WHERE rank <= 100"""
    sql["vocab_prune"] = f"WITH {VOCABULARY} SELECT id::INT AS id, token FROM vocabulary"
    sql["token_counts"] = f"WITH RECURSIVE {VOCABULARY}, txt AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {token_counts('txt')} SELECT doc_id, n AS tokens FROM txt JOIN tokens_of USING (t)"
    sql["packed_records"] = f"""WITH RECURSIVE {PACKED} SELECT id, (sum(n) OVER (ORDER BY id) - n)::BIGINT AS start, (sum(n) OVER (ORDER BY id))::BIGINT AS "end", weight FROM packed"""
    sql["sampled_windows"] = f"""WITH RECURSIVE {PACKED},
        cum AS (SELECT id, n, weight, sum(weight) OVER (ORDER BY id) AS hi FROM packed), tot AS (SELECT max(hi)::BIGINT AS total FROM cum),
        draws AS (SELECT i AS draw_id, {draw(7, 'i', 'total')} AS draw FROM generate_series(0, 499) g(i), tot),
        hit AS (SELECT draw_id, id, n, greatest(n - 65, 0) AS free FROM draws JOIN cum ON draw >= hi - weight AND draw < hi),
        on_runs AS (SELECT id, a, a + n AS z FROM runs WHERE trained UNION ALL SELECT id, total, total + 1 FROM ends WHERE last),
        starts AS (SELECT draw_id, id, unnest(generate_series(0, free)) AS s FROM hit),
        good AS (SELECT DISTINCT draw_id, st.id, s FROM starts st JOIN on_runs r ON r.id = st.id AND r.a <= s + 64 AND r.z > greatest(s + 1, 1)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY draw_id ORDER BY s) - 1 AS k, count(*) OVER (PARTITION BY draw_id) AS many FROM good),
        chosen AS (SELECT draw_id, id, s FROM ranked WHERE k = {draw(8, 'draw_id', 'many')})
        SELECT draw_id, c.id, s::INT AS start, 64 AS n, sum(least(r.z, s + 65) - greatest(r.a, s + 1))::INT AS targets FROM chosen c JOIN on_runs r ON r.id = c.id AND r.a <= s + 64 AND r.z > s + 1 GROUP BY ALL"""
    sql["doc_chunks"] = f"""WITH RECURSIVE t AS (SELECT doc_id, {strip("replace(replace(" + strip(newlines("nfc_normalize(coalesce(text, ''))")) + ", '<bos>', ''), '<eos>', '')")} AS t FROM documents),
        p0 AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda x: {strip('x')}), lambda x: x <> '') AS ps FROM t),
        p AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM p0),
        f AS (SELECT doc_id, 0::BIGINT AS i, '' AS open, []::VARCHAR[] AS out FROM p0
          UNION ALL SELECT f.doc_id, p.i,
            CASE WHEN length(p.p) > 300 THEN CASE WHEN open = '' OR length(open) + 2 + length(p.p) <= 300 THEN open ELSE '' END
              WHEN open = '' THEN p.p WHEN length(open) + 2 + length(p.p) <= 300 THEN open || chr(10) || chr(10) || p.p ELSE p.p END,
            list_concat(CASE WHEN open = '' OR length(open) + 2 + length(p.p) <= 300 THEN []::VARCHAR[] ELSE [open] END,
              CASE WHEN length(p.p) > 300 THEN list_filter(list_transform(generate_series(0, length(p.p) - 1, 300), lambda k: {strip('substr(p.p, k + 1, 300)')}), lambda x: x <> '') ELSE []::VARCHAR[] END)
          FROM f JOIN p ON p.doc_id = f.doc_id AND p.i = f.i + 1),
        parts AS (SELECT doc_id, i, unnest(out) AS content, generate_subscripts(out, 1) AS k FROM f
          UNION ALL SELECT doc_id, i, open, 1000000 FROM (SELECT doc_id, max(i) AS i, max_by(open, i) AS open FROM f GROUP BY doc_id) WHERE open <> '')
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1)::INT AS chunk, length(content)::INT AS chars, sha256(content) AS digest FROM parts"""
    sql["record_spans"] = "SELECT doc_id, (e - n)::BIGINT AS start, e::BIGINT AS \"end\" FROM (SELECT doc_id, length(coalesce(text, '')) AS n, sum(length(coalesce(text, ''))) OVER (ORDER BY doc_id) AS e FROM documents)"
    sql["draw_lookup"] = """WITH w AS (SELECT doc_id, length(coalesce(text, '')) AS n, sum(length(coalesce(text, ''))) OVER (ORDER BY doc_id) AS hi FROM documents),
        d AS (SELECT o_orderkey, (o_orderkey * 1000003 % (SELECT max(hi) FROM w))::BIGINT AS draw FROM orders)
        SELECT o_orderkey, draw, doc_id FROM d JOIN w ON draw >= hi - n AND draw < hi"""
    sql["preference_pairs"] = f"""WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at) AS rn FROM training_records WHERE id IS NOT NULL AND len(rejected_segments) > 0) WHERE rn = 1),
        c AS (SELECT id, source, list_filter(segments, lambda s: ({role("s['role']")}) IN ('system', 'user', 'assistant') AND {flat("coalesce(s['content'], '')")} <> '') AS g,
          list_filter(rejected_segments, lambda s: ({role("s['role']")}) IN ('system', 'user', 'assistant') AND {flat("coalesce(s['content'], '')")} <> '') AS b FROM d)
        SELECT id, {key('source')} AS source, 'preference' AS task, len(g)::INT AS n, len(b)::INT AS rejected FROM c WHERE len(g) > 0 AND len(b) > 0"""
    content = strip(newlines("coalesce(s['content'], '')"))
    seg_ok = lambda c: f"list_filter(coalesce({c}, []), lambda s: {content} <> '')"
    sql["canonical_records"] = f"""WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at) AS rn FROM training_records WHERE id IS NOT NULL) WHERE rn = 1),
        c AS (SELECT id, source, lower({strip("coalesce(task, '')")}) AS t, {seg_ok('segments')} AS g, {seg_ok('rejected_segments')} AS b FROM d)
        SELECT 'tl-corpus-v1' AS schema, id, {key('source')} AS source,
          CASE WHEN t IN ('lm', 'pretrain', 'pretraining', 'text') THEN 'lm' WHEN t IN ('sft', 'chat', 'instruction') THEN 'sft' WHEN t IN ('preference', 'pref', 'dpo', 'orpo', 'rlhf') THEN 'preference'
            WHEN len(b) > 0 THEN 'preference' WHEN list_bool_or(list_transform(g, lambda s: ({role("s['role']")}) <> 'text')) THEN 'sft' ELSE 'lm' END AS task, len(g)::INT AS n, len(b)::INT AS rejected,
          sha256(array_to_string(list_transform(g, lambda s: ({role("coalesce(s['role'], 'text')")}) || ':' || {content.replace("coalesce(", "nfc_normalize(coalesce(", 1).replace("'')", "''))", 1)} || ':' ||
            CASE WHEN coalesce(s['train'], ({role("coalesce(s['role'], 'text')")}) IN ('assistant', 'text')) THEN '1' ELSE '0' END), '|')) AS digest FROM c"""
    seg = "CASE WHEN json_exists(j, '$.segments') THEN j->'$.segments' WHEN json_exists(j, '$.messages') THEN j->'$.messages' WHEN json_exists(j, '$.chosen_segments') THEN j->'$.chosen_segments' WHEN json_exists(j, '$.chosen') THEN j->'$.chosen' END"
    sql["raw_payloads"] = f"""WITH v AS (SELECT raw_id, CASE WHEN json_valid(line) THEN line::JSON END AS j FROM raw_records WHERE line IS NOT NULL),
        k AS (SELECT raw_id, j, CASE WHEN j IS NULL THEN 'invalid' WHEN json_type(j) <> 'OBJECT' THEN 'scalar' WHEN coalesce(j->>'$.schema', '') = 'tl-corpus-v1' THEN 'canonical'
            WHEN json_exists(j, '$.chosen') AND json_exists(j, '$.rejected') THEN 'preference' WHEN json_exists(j, '$.messages') THEN 'messages' WHEN json_exists(j, '$.conversations') THEN 'conversations'
            WHEN json_exists(j, '$.input') AND json_exists(j, '$.output') THEN 'instruction' WHEN json_exists(j, '$.text') THEN 'text' ELSE 'other' END AS kind FROM v),
        s AS (SELECT raw_id, unnest(CASE WHEN json_type({seg}) = 'ARRAY' THEN ({seg})::JSON[] ELSE []::JSON[] END) AS s FROM k WHERE kind IN ('canonical', 'messages', 'preference')),
        n AS (SELECT raw_id, count(*) AS n FROM s WHERE ({role("coalesce(s->>'$.role', 'text')")}) IN ('system', 'user', 'assistant', 'text') AND {strip("coalesce(s->>'$.content', '')")} <> '' GROUP BY 1)
        SELECT raw_id, kind, {key("j->>'$.source'")} AS source, coalesce(n, 0)::INT AS n FROM k LEFT JOIN n USING (raw_id)"""
    sql["role_hist"] = f"WITH s AS (SELECT unnest(segments) AS s FROM training_records) SELECT {role("s['role']")} AS role, count(*) AS n FROM s GROUP BY 1"
    sql["reply_tree_paths"] = f"""WITH RECURSIVE {LATEST}, k AS (SELECT * FROM m WHERE {MESSAGE_OK}),
        leaf AS (SELECT message_id FROM k WHERE message_id NOT IN (SELECT parent_id FROM k WHERE parent_id IS NOT NULL)),
        walk AS (SELECT l.message_id AS leaf, l.message_id AS id, 0 AS steps, [l.message_id] AS seen FROM leaf l
          UNION ALL SELECT w.leaf, p.message_id, w.steps + 1, list_append(w.seen, p.message_id) FROM walk w JOIN k c ON c.message_id = w.id JOIN k p ON p.message_id = c.parent_id WHERE NOT list_contains(w.seen, p.message_id)),
        full_path AS (SELECT w.leaf, w.steps, k.role, k.text, coalesce(k.rank, 1000) AS rank FROM walk w JOIN k ON k.message_id = w.id),
        g AS (SELECT leaf, sum(CASE WHEN role = 'assistant' THEN rank ELSE 0 END)::BIGINT AS score, count(*)::INT AS n,
          sha256(string_agg(({role('role')}) || ':' || {strip(newlines('nfc_normalize(text)'))}, '|' ORDER BY steps DESC)) AS digest, max({role('role')}) FILTER (WHERE steps = 0) AS last FROM full_path GROUP BY leaf)
        SELECT leaf, score, n, digest FROM g WHERE last = 'assistant'"""
    sql["children_lists"] = f"""WITH {LATEST} SELECT c.parent_id, count(*)::INT AS n, string_agg(c.message_id, ',' ORDER BY coalesce(c.rank, 1000), c.message_id) AS children
        FROM m c JOIN m p ON p.message_id = c.parent_id GROUP BY c.parent_id"""
    sql["line_id_join"] = f"""WITH i AS (SELECT doc_id AS conv, unnest([doc_id, doc_id + 7, doc_id + 10000000, doc_id + 3]) AS line, unnest([0, 1, 2, 3]) AS pos FROM documents),
        j AS (SELECT conv, pos, coalesce(d.text, '') AS t FROM i LEFT JOIN documents d ON d.doc_id = i.line)
        SELECT conv, coalesce(string_agg(CASE WHEN pos % 2 = 0 THEN 'u' ELSE 'a' END, '' ORDER BY pos) FILTER (WHERE {strip('t')} <> ''), '') AS roles,
          coalesce(sum(length(t)) FILTER (WHERE {strip('t')} <> ''), 0)::INT AS chars FROM j GROUP BY conv"""
    sql["persona_reset"] = """WITH e AS (SELECT user_id % 16 AS file, event_id, event_id % 5 + 1 AS k FROM events),
        c AS (SELECT *, sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY event_id) AS conv FROM e)
        SELECT file, conv::BIGINT AS conv, (2 * count(*) FILTER (WHERE k > 1))::INT AS n, count(*) FILTER (WHERE k = 1)::INT AS personas FROM c GROUP BY file, conv HAVING count(*) FILTER (WHERE k > 1) > 0"""
    sql["speaker_roles"] = """WITH f AS (SELECT user_id, event_id, event_type, first_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS one FROM events)
        SELECT user_id, string_agg(CASE WHEN event_type = one THEN 'u' ELSE 'a' END, '' ORDER BY event_id) AS roles FROM f GROUP BY user_id"""
    label = "(?i)^(用户|User|Human|系统|System|助手|Assistant)[ \\t]*[：:]"
    sql["label_parse"] = f"""WITH {TURNS}, txt AS (SELECT d.id, {strip("coalesce(string_agg(" + RENDERED.replace('x.', 't.') + ", '' ORDER BY t.turn), '')")} AS text FROM d LEFT JOIN turns t USING (id) GROUP BY d.id),
        a AS (SELECT id, {strip("replace(replace(text, '<bos>', ''), '<eos>', '')")} AS text FROM txt),
        l AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM a),
        h AS (SELECT *, regexp_matches(line, '{label}') AS hit FROM l), g AS (SELECT *, sum(hit::INT) OVER (PARTITION BY id ORDER BY p) AS k FROM h),
        s AS (SELECT id, k, {strip("string_agg(CASE WHEN hit THEN regexp_replace(line, '" + label + "[ \\t]*', '') ELSE line END, chr(10) ORDER BY p)")} AS content,
          max(CASE WHEN hit THEN CASE WHEN regexp_matches(line, '(?i)^(用户|User|Human)') THEN 'user' WHEN regexp_matches(line, '(?i)^(系统|System)') THEN 'system' ELSE 'assistant' END END) AS role FROM g WHERE k > 0 GROUP BY id, k),
        o AS (SELECT * FROM s WHERE content <> '')
        SELECT txt.id, count(o.id)::INT AS n, sha256(coalesce(string_agg(o.role || ':' || o.content, '|' ORDER BY o.k), '')) AS digest FROM txt LEFT JOIN o USING (id) GROUP BY txt.id"""
    sql["category_accuracy"] = f"""WITH c AS (SELECT nullif({key('category')}, '') AS l, nullif({key('source')}, '') AS p FROM documents)
        SELECT count(*) FILTER (WHERE l IS NOT NULL AND p IS NOT NULL) AS n, round(avg(CASE WHEN l IS NOT NULL AND p IS NOT NULL THEN (l = p)::INT END) * 100, 6) AS accuracy FROM c"""
    sql["crawl_metadata"] = "SELECT count(*) AS total, array_to_string(list_sort(list(DISTINCT category) FILTER (WHERE category IS NOT NULL)), ',') AS categories, array_to_string(list_sort(list(DISTINCT source) FILTER (WHERE source IS NOT NULL)), ',') AS sources FROM documents"
    sql["char_stats"] = f"SELECT {key('source')} AS source, count(*) AS n, coalesce(sum(length(text)), 0)::BIGINT AS chars, count(*) FILTER (WHERE length(text) >= 200) AS long FROM documents GROUP BY 1"
    sql["regression_errors"] = "WITH d AS (SELECT l_extendedprice / 1000 - l_quantity AS d FROM lineitem) SELECT round(avg(abs(d)), 6) AS mae, round(sum(abs(d)), 2) AS sae, round(avg(d * d), 4) AS mse FROM d"
    losses = """z AS (SELECT vec_id, g, list_transform(l, lambda x: x - list_max(l) - ln(list_sum(list_transform(l, lambda y: exp(y - list_max(l)))))) AS lp
          FROM (SELECT vec_id, embedding::DOUBLE[] AS l, CASE WHEN vec_id % 3 = 0 THEN -100 ELSE label % 10 END AS g FROM embeddings) WHERE g <> -100)"""
    sql["masked_loss"] = f"""WITH {losses}, m AS (SELECT avg(-lp[g + 1]) AS loss, avg(-0.9 * lp[g + 1] - 0.1 * list_sum(lp) / len(lp)) AS smoothed, avg(-lp[g + 1] * exp(lp[g + 1])) AS dft, avg(exp(lp[g + 1])) AS gold_prob, count(*) AS valid FROM z)
        SELECT round(loss, 6) AS loss, round(smoothed, 6) AS smoothed, round(dft, 6) AS dft, round(gold_prob, 6) AS gold_prob, round(0.8 * smoothed + 0.2 * dft, 6) AS mixed, valid FROM m"""
    sql["eval_means"] = f"""WITH {losses}, b AS (SELECT vec_id // 50 AS batch, avg(-lp[g + 1]) AS loss, avg(-lp[g + 1] * exp(lp[g + 1])) AS dft, avg(exp(lp[g + 1])) AS gold_prob FROM z GROUP BY 1)
        SELECT round(avg(loss), 6) AS loss, round(avg(dft), 6) AS dft, round(avg(gold_prob), 6) AS gold_prob, count(*) AS batches FROM b"""
    sql["scatter_add"] = "SELECT l_linenumber, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1"
    sql["embedding_gather"] = """WITH n AS (SELECT max(vec_id) + 2 AS n FROM embeddings), t AS (SELECT o_orderkey AS key, 0 AS pos, o_orderkey % n AS vec_id FROM orders, n UNION ALL SELECT o_orderkey, 1, o_custkey % n FROM orders, n)
        SELECT key, pos, round(list_sum(list_transform(embedding, lambda x: (x * 2)::DOUBLE)), 3) AS total FROM t JOIN embeddings USING (vec_id)"""
    sql["learning_rates"] = """SELECT o_orderkey, round(CASE WHEN o_orderkey < 1000 THEN 0.01 * o_orderkey / 1000 ELSE 0.001 + 0.009 * 0.5 * (1 + cos(pi() * least(greatest((o_orderkey - 1000) / 11000.0, 0), 1))) END, 9) AS cosine,
        round(pow(512, -0.5) * least(pow(greatest(o_orderkey, 1), -0.5), greatest(o_orderkey, 1) * pow(4000, -1.5)), 9) AS inverse,
        round(0.1 * pow(0.5, floor(o_orderkey / 3000)), 9) AS decay, round(least(greatest((o_orderkey - 100) / 1000.0, 0), 1), 9) AS alpha FROM orders"""
    sql["numbered_ids"] = "SELECT c_custkey, c_mktsegment, format('row-{:07d}', row_number() OVER (ORDER BY c_mktsegment, c_custkey) - 1) AS id FROM customer"
    sql["full_batches"] = """WITH r AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 64 AS batch, count(*) OVER () // 64 AS whole FROM orders)
        SELECT batch::BIGINT AS batch, count(*) AS n, min(o_orderkey) AS first FROM r WHERE batch < whole GROUP BY 1"""
    sql["value_ema"] = """WITH l AS (SELECT user_id, list(value ORDER BY event_id) AS v FROM events WHERE value IS NOT NULL GROUP BY user_id)
        SELECT user_id, round(list_reduce(v, lambda a, x: a * 0.9 + x * (1 - 0.9)), 6) AS ema FROM l"""
    words = "list_distinct(string_split(lower({0}), ' '))"
    a, b = words.format("p_name"), words.format("p_type")
    show = "array_to_string(list_sort({0}), ' ')"
    sql["token_set_algebra"] = f"""SELECT p_partkey, {show.format(f'list_distinct(list_concat({a}, {b}))')} AS "both", {show.format(f'list_filter({a}, lambda x: list_contains({b}, x))')} AS shared,
        {show.format(f'list_filter({a}, lambda x: NOT list_contains({b}, x))')} AS own FROM part"""
    sql["first_paragraphs"] = f"""WITH p AS (SELECT doc_id, list_filter(list_transform(list_slice(string_split({newlines('text')}, chr(10) || chr(10)), 1, 5), lambda x: {strip('x')}), lambda x: length(x) > 50) AS p FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, len(p)::INT AS n, coalesce(list_sum(list_transform(p, lambda x: length(x))), 0)::INT AS chars FROM p"""
    pieces = lambda n, least: f"list_filter(list_transform(list_slice(string_split(coalesce(text, ''), chr(10) || chr(10)), 1, {n}), lambda x: {strip('x')}), lambda x: length(x) > {least})"
    sql["html_articles"] = f"""WITH p AS (SELECT doc_id, title, array_to_string({pieces(5, 50)}, chr(10) || chr(10)) AS c FROM documents)
        SELECT doc_id, length(coalesce(title, ''))::INT AS title, length(c)::INT AS chars, sha256(c) AS digest FROM p"""
    sql["news_articles"] = f"""WITH p AS (SELECT doc_id, array_to_string({pieces(10**9, 30)}, chr(10) || chr(10)) AS c FROM documents), q AS (SELECT doc_id, CASE WHEN length(c) + 2 > 100 THEN c ELSE '' END AS c FROM p)
        SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Heading' ELSE 'Page' END AS title, length(c)::INT AS chars, sha256(c) AS digest FROM q"""
    tight = "regexp_replace(regexp_replace({0}, '([\\x{{4e00}}-\\x{{9fff}}\\p{{P}}]) ([\\x{{4e00}}-\\x{{9fff}}\\p{{Nd}}\\p{{P}}])', '\\1\\2', 'g'), '(\\p{{Nd}}) ([\\x{{4e00}}-\\x{{9fff}}\\p{{P}}])', '\\1\\2', 'g')"
    sql["tightened_text"] = f"""WITH c AS (SELECT doc_id, {flat("replace(nfc_normalize(text), '_comma_', '，')")} AS t FROM documents), d AS (SELECT doc_id, {tight.format('t')} AS t FROM c), e AS (SELECT doc_id, {tight.format('t')} AS t FROM d)
        SELECT doc_id, sha256(t) AS digest, length(t)::INT AS chars FROM e"""
    blank = r"[\t \x1f\p{Zs}]"
    sql["cleaned_text"] = rf"""WITH n AS (SELECT doc_id, nfc_normalize(text) AS t FROM documents), u AS (SELECT doc_id, t, {newlines('t')} AS l FROM n),
        v AS (SELECT *, regexp_replace(regexp_replace(l, '[\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'), '{blank}+(\n|$)', '\1', 'g') AS m FROM u)
        SELECT doc_id, sha256({strip("regexp_replace(m, '\\n{3,}', chr(10) || chr(10), 'g')")}) AS lines, sha256({flat('t')}) AS flat,
          sha256({strip(f"regexp_replace(regexp_replace(l, '{blank}+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g')")}) AS each_line, sha256({strip('l')}) AS normal FROM v"""
    sql["trimmed_dialogs"] = f"""WITH RECURSIVE {TURNS}, {trimmed('turns', 4, 600)} SELECT d.id, count(t.id)::INT AS n, coalesce(sum(length(t.content)), 0)::INT AS chars FROM d LEFT JOIN trimmed t USING (id) GROUP BY d.id"""
    content = f"coalesce({strip(newlines("replace(nfc_normalize(coalesce(s['content'], '')), '_comma_', ',')"))}, '')"
    lines = TURNS.replace(flat("nfc_normalize(coalesce(s['content'], ''))"), content)
    mix = f"""WITH RECURSIVE {lines}, {trimmed('turns', 12, 6000)},
        whole AS (SELECT id, any_value(source) AS source, count(*)::INT AS n, count(*) FILTER (WHERE role <> 'system') AS k, bool_or(role = 'user') AS u, bool_or(role = 'assistant') AS a, sum(length(content)) AS chars,
            coalesce(sum(length(content)) FILTER (WHERE role = 'assistant'), 0) AS said, coalesce(max(length(content)) FILTER (WHERE role = 'assistant'), 0) AS top, coalesce(max(length(content)) FILTER (WHERE role = 'user'), 0) AS asked,
            string_agg(role || ': ' || content, chr(10) ORDER BY turn) AS t, lower(string_agg(content, chr(10) ORDER BY turn) FILTER (WHERE role = 'assistant')) AS replies,
            string_agg(role || ':' || {flat('lower(content)')}, chr(10) ORDER BY turn) FILTER (WHERE role IN ('user', 'assistant')) AS hash FROM trimmed GROUP BY id),
        fit AS (SELECT *, len(regexp_extract_all(t, '\\p{{L}}')) AS letters, len(regexp_extract_all(t, '[A-Za-z]')) AS latin FROM whole),
        good AS (SELECT * FROM fit WHERE k >= 2 AND u AND a AND chars >= 40 AND asked <= 1600 AND said >= 20 AND top <= 2400 AND letters >= 20 AND latin / letters >= 0.9 AND NOT ({" OR ".join(f"contains(replies, {quoted(x)})" for x in BAD_ASSISTANT_PHRASES)}))"""
    seen, picks = "", (("lanternchat", 150), ("feedbacknotes", 100), ("rest", 1_000_000))
    for name, quota in picks:
        own = f"source = '{name}'" if name != "rest" else "source NOT IN ('lanternchat', 'feedbacknotes')"
        mix += f""", n_{name} AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY id) AS j FROM good WHERE {own} {seen}),
        q_{name} AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY id) AS rank FROM n_{name} WHERE j = 1) WHERE rank <= {quota})"""
        seen += f" AND hash NOT IN (SELECT hash FROM q_{name})"
    sql["chat_mix"] = mix + " UNION ALL ".join(f"SELECT '{n}' AS source_name, id, n, rank::INT AS rank FROM q_{n}" for n, _ in picks)
    sql["merge_corpora"] = f"""WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at) AS rn FROM training_records WHERE id IS NOT NULL) WHERE rn = 1),
        names AS (SELECT DISTINCT {key('name')} AS k FROM source_specs WHERE {key('name')} <> ''),
        o AS (SELECT k, row_number() OVER (ORDER BY CASE k WHEN 'worldtalk' THEN 0 WHEN 'lanternchat' THEN 1 WHEN 'smalltalkzh' THEN 2 ELSE 3 END, k) AS ord FROM names),
        c AS (SELECT coalesce(o.k, 'rest') AS corpus, coalesce(o.ord, 1000) AS ord, source, segments FROM d LEFT JOIN o ON o.k = {key('source')}),
        w AS (SELECT * FROM c UNION ALL SELECT 'again', 1001, source, segments FROM c WHERE corpus = 'worldtalk'),
        f AS (SELECT min((ord, corpus)) AS first FROM w GROUP BY source, segments)
        SELECT w.corpus, count(*) AS input, (SELECT count(*) FROM f WHERE f.first[2] = w.corpus) AS written, count(*) - (SELECT count(*) FROM f WHERE f.first[2] = w.corpus) AS duplicates FROM w GROUP BY w.corpus"""
    sql["softmax_draws"] = f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS l, {draw(3, 'vec_id', '1000000')} / 1e6 AS u FROM embeddings),
        x AS (SELECT vec_id, u, unnest(l) AS v, generate_subscripts(l, 1) - 1 AS i FROM e), t AS (SELECT vec_id, list_sort(l, 'DESC')[5] AS fifth, list_max(l) AS top FROM e),
        p AS (SELECT vec_id, u, i, v = top AS best, CASE WHEN v >= fifth THEN exp((v - top) / 0.7) ELSE 0 END AS w FROM x JOIN t USING (vec_id)),
        c AS (SELECT vec_id, u, i, best, sum(w) OVER (PARTITION BY vec_id ORDER BY i) / sum(w) OVER (PARTITION BY vec_id) AS hi FROM p)
        SELECT vec_id, least(count(*) FILTER (WHERE hi <= u), count(*) - 1)::INT AS drawn, min(i) FILTER (WHERE best)::INT AS best FROM c GROUP BY vec_id"""
    bounded = QUALITY.replace("WITH ", "WITH RECURSIVE ", 1)
    at = bounded.index("o AS (SELECT *, row_number()")
    limits = "CASE WHEN reason <> 'ok' THEN reason WHEN a.n + 2 < 24 THEN 'too_short_record' WHEN a.n + 2 > 640 THEN 'too_long_record' WHEN b.n > 420 THEN 'too_long_prompt' WHEN c.n < 12 THEN 'too_short_response' WHEN c.n > 260 THEN 'too_long_response' ELSE 'ok' END"
    build = bounded[:at] + f"""{VOCABULARY}, txt AS (SELECT unnest([record, asked, answer]) AS t FROM v WHERE reason = 'ok'), {token_counts('txt')},
        vv AS (SELECT v.* EXCLUDE (reason), {limits} AS reason, a.n + 2 AS record_tokens, b.n AS prompt_tokens, c.n AS response_tokens FROM v LEFT JOIN tokens_of a ON a.t = record LEFT JOIN tokens_of b ON b.t = asked LEFT JOIN tokens_of c ON c.t = answer),
        """ + bounded[at:].replace("FROM v)", "FROM vv)") + """, acc AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id, turn) AS rank FROM st WHERE status = 'accepted'),
        last AS (SELECT source, id AS last_id, turn AS last_turn FROM acc WHERE rank = 200),
        seen AS (SELECT st.* FROM st LEFT JOIN last USING (source) WHERE last_id IS NULL OR (id, turn) <= (last_id, last_turn))
        """
    sql["quality_build"] = build + """SELECT format('quality-{:07d}', row_number() OVER (ORDER BY source, id, turn) - 1) AS id, source, 'sft' AS task, len(parts)::INT AS n, record_tokens::INT AS record_tokens, response_tokens::INT AS response_tokens FROM seen WHERE status = 'accepted'"""
    sums = ", ".join(f"coalesce(sum({x}_tokens) FILTER (WHERE status = 'accepted'), 0)::BIGINT AS sum_{x}_tokens" for x in ("record", "prompt", "response"))
    sql["quality_stats"] = build + f""", why AS (SELECT source, string_agg(reason || '=' || n, ',' ORDER BY reason) AS reasons FROM (SELECT source, reason, count(*) AS n FROM seen WHERE status = 'skipped' GROUP BY ALL) GROUP BY source)
        SELECT source, count(DISTINCT id) AS scanned, count(*) AS candidates, count(*) FILTER (WHERE status = 'accepted') AS written, count(*) FILTER (WHERE status = 'duplicate') AS duplicates, count(*) FILTER (WHERE status = 'skipped') AS skipped,
          {sums}, coalesce(any_value(reasons), '') AS reasons, count(*) FILTER (WHERE status = 'accepted') > 0 AS has_chars FROM seen LEFT JOIN why USING (source) GROUP BY source"""
    return sql
