"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from gaugeworks.llm.licenses import TEMPLATES, Template

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS k FROM i)),
dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM iw))),
hits AS (SELECT doc_id, k, n, item_id FROM dw JOIN iw USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP2 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)] AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / w, source) AS j FROM s),
c AS (SELECT *, ((SELECT sum(size) FROM d) * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER before, 0)::DOUBLE) / (sum(w) OVER (ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
      FROM o WINDOW before AS (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT coalesce((SELECT level FROM c WHERE w * level < 2 * source_size ORDER BY j LIMIT 1), 1e300) AS level),
t AS (SELECT source, source_size, least((2 * source_size)::DOUBLE, w * l.level) AS target FROM s, l),
k AS (SELECT *, md5('mix-17:' || coalesce(doc_id::VARCHAR, '')) AS key FROM d),
r AS (SELECT k.doc_id, k.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
             coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * least(whole + CASE WHEN 2 * ahead + size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END, 2))::BIGINT AS taken
FROM r
"""


def _op4(rules: tuple[tuple[str, str], ...] = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))) -> str:
    rest = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    cases = []
    for verdict, r in sorted(rules, key=lambda x: -len(x[1])):
        h, _, p = r.partition("/")
        cases.append((verdict, r, f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}'))"))
    rule = "CASE " + " ".join(f"WHEN {fits} THEN '{r}'" for _, r, fits in cases) + " END"
    blocks = ", ".join(f"'{r}'" for verdict, r, _ in cases if verdict == "block")
    out = f"""
WITH raw AS (SELECT page_id, coalesce({rest}, '') AS rest FROM pages),
cut AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM raw),
u AS (SELECT *, {rule} AS rule,
      list_transform(string_split(substr(path, 2), '/'), lambda s: CASE WHEN length(s) > 24 THEN '{{slug}}' ELSE regexp_replace(s, '[0-9]+', '{{n}}', 'g') END) AS segments FROM cut),
g AS (SELECT *, CASE WHEN rule IN ({blocks}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS given, array_to_string(segments, '/') AS shape FROM u),
t0 AS (SELECT host, shape, any_value(segments) AS segments, '' AS template, count(*)::DOUBLE AS n, count(given)::DOUBLE AS labelled, count(*) FILTER (given = 'block')::DOUBLE AS bad FROM g GROUP BY host, shape)"""
    for k in (1, 2, 3):
        out += f""",
h{k} AS (SELECT *, coalesce(segments[{k}], '') AS child, coalesce(segments[{k} + 1], '') AS nxt, greatest(len(segments) - {k}, 0) * n AS below FROM t{k - 1}),
c{k} AS (SELECT host, template, child, sum(n) AS n, sum(labelled) AS labelled, sum(bad) AS bad, sum(below) AS below, count(DISTINCT nxt) AS fan FROM h{k} GROUP BY ALL),
n{k} AS (SELECT host, template, count(*) AS children, sum(n) AS an, sum(labelled) AS al, sum(bad) AS ab, sum(below) AS aw, sum(fan) AS af FROM c{k} GROUP BY ALL),
d{k} AS (SELECT host, template, child, CASE WHEN (children > 20 AND n * 20 < an) OR (labelled > 0 AND abs(below * an - aw * n) * 2 <= n * an
         AND (bad * al - ab * labelled) * (bad * al - ab * labelled) <= 4 * ab * (al - ab) * labelled)
         OR (labelled = 0 AND 2 * al >= an AND abs(below * an - aw * n) * 2 <= n * an AND fan * children * 2 >= af AND fan * children <= 2 * af) THEN '*' ELSE child END AS token FROM c{k} JOIN n{k} USING (host, template)),
t{k} AS (SELECT host, shape, segments, template || '/' || token AS template, n, labelled, bad FROM h{k} JOIN d{k} USING (host, template, child))"""
    return out + """,
f AS (SELECT host, shape, template || '/' || array_to_string(segments[4:], '/') AS template, labelled, bad FROM t3),
p AS (SELECT host, template, (sum(bad) + 2) / (sum(labelled) + 4) AS purity FROM f GROUP BY ALL),
m AS (SELECT host, shape, purity >= 0.8 AS reject FROM f JOIN p USING (host, template))
SELECT page_id, host, path, rule, coalesce(given, CASE WHEN reject THEN 'block' ELSE 'allow' END) AS verdict FROM g LEFT JOIN m USING (host, shape)
"""


def _op5() -> str:
    esc = lambda x: _controls(f"replace({x}, chr(92), chr(92) || chr(92))")
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
      coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
      sum(length('<|turn|><|text|><|end|>') + length({esc("role")}) + length({esc("text")})) AS chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars FROM g
"""


def _controls(sql: str) -> str:
    for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"):
        sql = f"replace({sql}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return sql


OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN strlen(html) >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(html) >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m
"""

OP6 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id, vec_id AS reached FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reached),
c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""

OP10 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - 50)) AS p FROM d)),
m AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s),
hit AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50, true) AS fresh FROM g JOIN m USING (s) WHERE least < doc_id),
num AS (SELECT doc_id, p, sum(fresh::INTEGER) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM hit),
run AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM num GROUP BY doc_id, k),
edge AS (SELECT doc_id, b AS lo, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS hi FROM run UNION ALL SELECT doc_id, 0, min(a) FROM run GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * lo + 1, coalesce(2 * (hi - lo), length(h))), '' ORDER BY lo) AS h FROM edge JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM run GROUP BY doc_id)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""

def _op11(templates: tuple[Template, ...]) -> str:
    """Grams, diagonals and shares as plain joins over word lists."""
    listed = ", ".join(f"({i}, '{t.label}', {t.base}, {t.share}::DOUBLE, {t.gram}, {t.slack}, {t.votes}, [{', '.join(repr(w.decode()) for w in t.words)}])" for i, t in enumerate(templates))
    return f"""
WITH t(t, label, base, share, k, slack, needed, ws) AS (VALUES {listed}),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
g AS (SELECT doc_id, k, i - 1 AS pos, array_to_string(ws[i:i + k - 1], ' ') AS gram FROM (SELECT doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM d, (VALUES (2), (5)) AS sizes(k))),
tg AS (SELECT t, k, i - 1 AS place, array_to_string(ws[i:i + k - 1], ' ') AS gram FROM (SELECT t, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM t)),
v AS (SELECT doc_id, t, pos - place AS diagonal, count(*) AS votes FROM g JOIN tg USING (k, gram) GROUP BY ALL),
a AS (SELECT v.*, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, t ORDER BY diagonal) > slack, true)::INTEGER AS apart, needed FROM v JOIN t USING (t)),
m AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS grp FROM a),
c AS (SELECT doc_id, t, grp, list(diagonal) AS ds FROM m GROUP BY doc_id, t, grp HAVING sum(votes) >= any_value(needed)),
p AS (SELECT doc_id, t, grp, diagonal, unnest(generate_series(1, len(t.ws))) AS place, t.ws AS tw, d.ws AS dw FROM (SELECT doc_id, t, grp, unnest(ds) AS diagonal FROM c) JOIN t USING (t) JOIN d USING (doc_id)),
s AS (SELECT doc_id, t, count(DISTINCT place) / any_value(len(tw))::DOUBLE AS stands, min(diagonal + place - 1) AS start FROM p WHERE diagonal + place >= 1 AND dw[diagonal + place] = tw[place] GROUP BY doc_id, t, grp),
f AS (SELECT s.*, label, base FROM s JOIN t USING (t) WHERE stands >= share),
r AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
 array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(stands) AS score FROM f GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN r USING (doc_id)
"""

OP13 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents),
h AS (SELECT *, length(text) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
 CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
 sha256(text) AS restored_sha256
FROM p
"""

def _secrets_base() -> str:
    lower = f"translate(text, '{_UPPER}', '{_LOWER}')"
    kinds = (("assign", lower, r"(?:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([a-z0-9+/_.=-]+)", 1, 8), ("access", "text", "AKIA[A-Z0-9]+", 0, 16), ("hex", "text", "[0-9a-f]+", 0, 32))
    found = " UNION ALL ".join(
        f"SELECT doc_id, '{kind}' AS kind, {k} AS ord, {least} AS least, regexp_extract_all({of}, '{pattern}') AS hits, regexp_extract_all({of}, '{pattern}', {group}) AS parts, regexp_split_to_array({of}, '{pattern}') AS rest FROM documents WHERE text IS NOT NULL"
        for k, (kind, of, pattern, group, least) in enumerate(kinds)
    )
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}')::BIGINT AS n_{kind}" for kind, *_ in kinds)
    return f"""
WITH found AS ({found}),
each AS (SELECT doc_id, kind, ord, least, unnest(hits) AS hit, unnest(parts) AS part, unnest(rest[1:len(hits)]) AS before, unnest(generate_series(1, len(hits))) AS i FROM found WHERE len(hits) > 0),
placed AS (SELECT *, sum(length(before) + length(hit)) OVER (PARTITION BY doc_id, ord ORDER BY i) AS stop FROM each),
good AS (SELECT doc_id, kind, ord, (stop - length(hit))::BIGINT AS start, stop::BIGINT AS stop FROM placed WHERE length(part) >= least),
sums AS (SELECT doc_id, {counts}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans FROM good GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM documents AS d LEFT JOIN sums USING (doc_id)
"""


ORACLES: dict[str, str] = {
    "secrets_base": _secrets_base(),
    "op1_decontamination": OP1,
    "op2_mixing": OP2,
    "op4_urls": _op4(),
    "urls_by_template": _op4((*(("block", f"{host}/en/{d}") for host in ("com", "net") for d in range(1, 8)), *(("allow", f"org/en/{d}") for d in range(1, 6)), ("block", "org/de/"))),
    "op5_chat": _op5(),
    "op6_embeddings": OP6,
    "embeddings_near": OP6.replace(">= 0.95", ">= 0.42"),
    "op8_warc": OP8,
    "op10_suffixes": OP10,
    "op11_licenses": _op11(TEMPLATES),
    "op13_infill": OP13,
}
