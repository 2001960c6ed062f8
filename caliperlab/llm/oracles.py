"""DuckDB SQL for the corpus queries that SQL can express."""

_NONE = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR))"
_NEXT = {"n": "u", "s": "u", "u": "a", "a": "u"}
_ROLE = {"u": "user", "a": "assistant"}
#: CRC-32 of conv_id:turn: bits of the reflected polynomial, byte by byte.
_CRC = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END))"""
_CRC = f"xor({_CRC}, CAST(4294967295 AS BIGINT))"


def _edit(state: str, cost: str, letters: str, out: str, when: str = "true") -> str:
    return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letters}', 'o': {state}.o || {out}}} END"


def _moves(to: str) -> str:
    """The least of what leads to a state by a row: deleted, kept or reroled, after an inserted turn or none."""
    nl, found = "chr(10) || ", [_edit(to, "3", "D", "''")]
    if to == "s":
        found.append(_edit("n", "t", "K", nl + "role || ':' || text", "live AND i = 's'"))
    for state, role in _NEXT.items():
        for role, cost, letter, before in ((role, "t", "", ""), (_NEXT[role], "t + 2", "I", f"{nl}'{_ROLE[role]}:' || ")):  # noqa: B020
            if role == to:
                found.append(_edit(state, cost, letter + "K", before + nl + "role || ':' || text", f"live AND i = '{to}'"))
                found.append(_edit(state, cost + " + 2", letter + "R", before + nl + f"'{_ROLE[to]}:' || text", "live"))
    return f"list_min([{', '.join(found)}])"


def _end(state: str, letters: str, out: str) -> str:
    return _edit(state, str(2 * len(letters)), letters, f"chr(10) || '{out}'")


ORACLES = {
    "op1_chat_formatting": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v),
e AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'),
    '</s>', '<\/s>'), '<s>', '<\s>'), '[/INST]', '[\/INST]'), '[INST]', '[\INST]'), '[/ROLE]', '[\/ROLE]'), '[ROLE]', '[\ROLE]') AS esc FROM t)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(esc) + 7 + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 0 ELSE 13 + length(role) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op2_url_filter": r"""
WITH r(host_r, path_r, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id,
  translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (
  SELECT h.*, r.host_r || r.path_r AS rule, r.verdict,
    row_number() OVER (PARTITION BY h.page_id, h.host, h.path ORDER BY length(r.host_r || r.path_r) DESC, length(r.host_r) DESC) AS k
  FROM h LEFT JOIN r ON (h.host = r.host_r OR ends_with(h.host, '.' || r.host_r)) AND starts_with(h.path, r.path_r))
SELECT CAST(page_id AS BIGINT) AS page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE k = 1""",
    "op3_decontamination": r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') AS ws FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') FROM benchmark),
g AS (
  SELECT DISTINCT kind, id, array_to_string(ws[k : k + 4], ' ') AS s FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) u(k) WHERE len(ws) > 0),
n AS (SELECT id, count(*) AS n FROM g WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, any_value(n.n) AS n_item_shingles, count(*) AS n_shared, count(*) / any_value(n.n) AS containment
FROM g i JOIN g d ON i.s = d.s AND i.kind = 'i' AND d.kind = 'd' JOIN n ON n.id = i.id
GROUP BY d.id, i.id HAVING count(*) >= 0.8 * any_value(n.n) - 1e-9""",
    "op9_embedding_dedup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.98),
r(s, t) AS (SELECT a, b FROM p UNION SELECT r.s, p.b FROM r JOIN p ON r.t = p.a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a),
c AS (SELECT s, min(t) AS m FROM r GROUP BY s)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(least(e.vec_id, c.m), e.vec_id) AS component_id, coalesce(least(e.vec_id, c.m), e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.s = e.vec_id""",
    "op11_lexical_search": r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
tf AS (SELECT doc_id, t, count(*) AS tf FROM w GROUP BY ALL),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM d),
df AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY t, nn),
m AS (SELECT doc_id, 100 - 90 + (90 * n * nn) // l AS m FROM d, s),
c AS (SELECT i.item_id, tf.doc_id, CAST(sum(df.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * m.m))) AS BIGINT) AS score
  FROM i JOIN tf ON tf.t = i.t JOIN df ON df.t = i.t JOIN m ON m.doc_id = tf.doc_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0)
SELECT CAST(item_id AS BIGINT) AS item_id, CAST(rank AS INTEGER) AS rank, CAST(doc_id AS BIGINT) AS doc_id, score FROM r WHERE rank <= 10""",
    "op13_turn_repair": rf"""
WITH RECURSIVE raw AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, crc32_of % 20 AS f
  FROM (SELECT *, {_CRC} AS crc32_of FROM conversations)),
dam AS (
  SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM raw, unnest(range(CASE f WHEN 3 THEN 2 ELSE 1 END)) WHERE f <> 0),
o AS (
  SELECT *, row_number() OVER w AS p, lag(role) OVER w AS was, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS z
  FROM dam WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
fl AS (
  SELECT *, CASE WHEN z = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'duplicate' WHEN z NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM o),
tot AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (was IS NOT NULL AND left(was, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(p) AS last
  FROM fl GROUP BY conv_id),
g(conv_id, p, n, s, u, a) AS (
  SELECT conv_id, CAST(0 AS BIGINT), {{'c': CAST(0 AS BIGINT), 'a': '', 'o': ''}}, {_NONE}, {_NONE}, {_NONE} FROM tot
  UNION ALL
  SELECT conv_id, p, {_moves("n")}, {_moves("s")}, {_moves("u")}, {_moves("a")}
  FROM (SELECT g.conv_id, fl.p, g.n, g.s, g.u, g.a, left(fl.role, 1) AS i, fault NOT IN ('blank', 'duplicate') AS live, CASE fault WHEN 'truncated' THEN 1 ELSE 0 END AS t, fl.role, fl.text
    FROM g JOIN fl ON fl.conv_id = g.conv_id AND fl.p = g.p + 1)),
e AS (
  SELECT g.conv_id, list_min([n, a, {_end("u", "I", "assistant:")}, {_end("s", "II", "user:' || chr(10) || 'assistant:")}]) AS r
  FROM g JOIN tot ON tot.conv_id = g.conv_id AND tot.last = g.p)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(r.c, 0) AS cost, coalesce(r.a, '') AS audit, sha256(coalesce(r.o[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT CAST(conv_id AS BIGINT) AS conv_id FROM conversations) k LEFT JOIN tot ON tot.conv_id = k.conv_id LEFT JOIN e ON e.conv_id = k.conv_id""",
}
