"""SQL twins of the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

from .collocations import LEAST, SHARE, TOP
from .collocations import SCALE as SCORE_SCALE
from .debruijn import WINDOW
from .quality_rules import COST, DELTA, RISK, RULES
from .sharding import SHARDS, SLOTS
from .suffix_dedup import LENGTH
from .vector_codes import ENTRIES, PARTS, ROUNDS, SCALE

_GRID = ", ".join(f"('{rule}', {c}, {cutoff}::DOUBLE)" for rule, (_, _, cutoffs) in RULES.items() for c, cutoff in enumerate(cutoffs))
_TESTS = sum(len(cutoffs) for _, _, cutoffs in RULES.values())
_ALPHA = RISK / len(RULES)
_RATIO = "CASE g.rule " + " ".join(f"WHEN '{rule}' THEN {top} / greatest({bottom}, 1)" for rule, (top, bottom, _) in RULES.items()) + " END"

QUALITY_RULES = rf"""WITH RECURSIVE d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, list_filter(regexp_split_to_array(t, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM d),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w)),
often AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM tri),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM often, (VALUES (0), (1), (2)) o(j) WHERE n > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE length(regexp_replace(l, '[ \t\n\x0b\f\r]', '', 'g')) > 0 GROUP BY doc_id),
c AS (SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[ \t\n\x0b\f\r]', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
y AS (SELECT doc_id, max(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT f.*, good FROM f JOIN y USING (doc_id) WHERE NOT base_failed),
g AS (SELECT * FROM (VALUES {_GRID}) v(rule, c, cutoff)),
tried AS (SELECT lang, g.rule, g.c, g.cutoff, count(*) FILTER (good AND {_RATIO} > g.cutoff) AS lost, count(*) FILTER (NOT good AND {_RATIO} > g.cutoff) AS caught FROM h, g GROUP BY lang, g.rule, g.c, g.cutoff),
n AS (SELECT lang, count(*) FILTER (good) AS n FROM h GROUP BY lang),
cdf AS (SELECT lang, n, 0 AS i, pow(1 - {_ALPHA}::DOUBLE, n) AS term, pow(1 - {_ALPHA}::DOUBLE, n) AS total FROM n UNION ALL SELECT lang, n, i + 1, term * (n - i) / (i + 1) * {_ALPHA}::DOUBLE / (1 - {_ALPHA}::DOUBLE), total + term * (n - i) / (i + 1) * {_ALPHA}::DOUBLE / (1 - {_ALPHA}::DOUBLE) FROM cdf WHERE i < ceil(n * {_ALPHA}::DOUBLE)),
allowed AS (SELECT lang, coalesce(max(i) FILTER (total <= {DELTA}::DOUBLE / ((SELECT count(*) FROM n) * {_TESTS})), -1) AS k FROM cdf GROUP BY lang),
best AS (SELECT tried.lang, rule, cutoff FROM tried JOIN allowed ON tried.lang IS NOT DISTINCT FROM allowed.lang WHERE lost <= k AND caught - {COST} * lost > 0 QUALIFY row_number() OVER (PARTITION BY tried.lang, rule ORDER BY caught - {COST} * lost DESC, c) = 1),
rejected AS (SELECT DISTINCT f.doc_id FROM f JOIN best g ON f.lang IS NOT DISTINCT FROM g.lang WHERE {_RATIO} > g.cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept FROM f"""

CHAT = """WITH u AS (SELECT conv_id, turn, text, count(*) OVER (PARTITION BY conv_id, turn) AS n FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) = 1),
r AS (SELECT conv_id, turn - 1 AS turn, text, count(*) OVER (PARTITION BY conv_id, turn) AS n FROM conversations WHERE role IS NULL OR role <> 'user' QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) = 1),
b AS (SELECT conv_id, turn, u.turn IS NOT NULL AS called, r.turn IS NOT NULL AS answered, u.text AS prompt, r.text AS answer, coalesce(u.n, 0) AS n_calls, coalesce(r.n, 0) AS n_results, conv_id || ':' || turn AS call_id FROM u FULL JOIN r USING (conv_id, turn)),
j AS (SELECT *, CASE WHEN called THEN '{"arguments":{"prompt":' || coalesce(to_json(prompt)::VARCHAR, 'null') || ',"turn":' || turn || '},"id":"' || call_id || '","name":"reply"}' ELSE 'null' END AS c, CASE WHEN answered THEN '{"content":' || coalesce(to_json(answer)::VARCHAR, 'null') || ',"id":"' || call_id || '"}' ELSE 'null' END AS a,
 CASE WHEN NOT called THEN NULL WHEN prompt IS NULL THEN '$.prompt: not string' WHEN prompt = '' THEN '$.prompt: length' WHEN turn < 0 THEN '$.turn: out of bounds' END AS error FROM b)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN called THEN turn ELSE turn + 1 END, call_id) - 1 AS position, call_id, CASE WHEN called THEN 'reply' END AS name, CASE WHEN NOT called THEN 'orphan' WHEN answered THEN 'linked' ELSE 'unanswered' END AS status, false AS dangling, false AS cyclic, n_calls, n_results, called AND error IS NULL AS valid, error, '{"call":' || c || ',"result":' || a || '}' AS json FROM j"""

CALL_ORDER = """WITH RECURSIVE l AS (SELECT l_orderkey AS conv_id, l_linenumber::BIGINT AS turn, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
d AS (SELECT DISTINCT conv_id, turn, x AS on_turn FROM (SELECT conv_id, turn, unnest(CASE WHEN conv_id % 3 > 0 THEN list_filter([p % 11 + 1, s % 9 + 1], lambda x: x <> turn) ELSE [p % 11 + 1] END) AS x FROM l)),
e AS (SELECT d.* FROM d JOIN l ON d.conv_id = l.conv_id AND d.on_turn = l.turn),
loose AS (SELECT DISTINCT d.conv_id, d.turn FROM d LEFT JOIN l ON d.conv_id = l.conv_id AND d.on_turn = l.turn WHERE l.turn IS NULL),
n AS (SELECT conv_id, count(*) AS n FROM l GROUP BY 1),
walk AS (SELECT conv_id, turn, 0 AS steps FROM l UNION SELECT e.conv_id, e.turn, steps + 1 FROM walk JOIN e ON e.conv_id = walk.conv_id AND e.on_turn = walk.turn JOIN n ON n.conv_id = e.conv_id WHERE steps < n),
circle AS (SELECT conv_id, turn FROM walk JOIN n USING (conv_id) WHERE steps = n),
r AS (SELECT conv_id, turn, turn AS ready, 0 AS depth FROM l UNION SELECT e.conv_id, e.turn, r.ready, r.depth + 1 FROM r JOIN e ON e.conv_id = r.conv_id AND e.on_turn = r.turn WHERE (r.ready > e.turn OR r.ready = e.turn AND r.depth >= 0) AND NOT EXISTS (SELECT 1 FROM circle c WHERE c.conv_id = r.conv_id AND c.turn = r.turn)),
k AS (SELECT conv_id, turn, max((ready, depth)) AS k FROM r GROUP BY 1, 2),
f AS (SELECT k.conv_id, 'c' || k.turn AS call_id, k.k, loose.turn IS NOT NULL AS dangling, circle.turn IS NOT NULL AS cyclic FROM k LEFT JOIN loose ON k.conv_id = loose.conv_id AND k.turn = loose.turn LEFT JOIN circle ON k.conv_id = circle.conv_id AND k.turn = circle.turn)
SELECT conv_id, call_id, row_number() OVER (PARTITION BY conv_id ORDER BY cyclic, k, call_id) - 1 AS position, dangling, cyclic FROM f"""

#: The polynomial of CRC-32, reflected (a fixed value); its table follows from it.
SHARDING = f"""WITH RECURSIVE crcs AS (SELECT list(v ORDER BY x) AS t FROM (SELECT x, list_reduce(list_prepend(x::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, {0xEDB88320}) ELSE c >> 1 END) AS v FROM range(256) r(x))),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS txt FROM documents),
b AS (SELECT rid, list(('0x' || substr(h, 2 * i + 1, 2))::BIGINT ORDER BY i) AS bytes FROM (SELECT rid, hex(txt) AS h, unnest(range(strlen(txt))) AS i FROM d) GROUP BY rid),
c AS (SELECT rid, xor(list_reduce(list_prepend({0xFFFFFFFF}, bytes), lambda c, x: xor(crcs.t[(xor(c, x) & 255) + 1], c >> 8)), {0xFFFFFFFF}) AS crc FROM b, crcs),
s AS (SELECT doc_id, strlen(txt)::BIGINT + 1 AS size, coalesce(crc, 0)::BIGINT AS text_crc32, (('0x' || substr(md5(concat_ws('|', doc_id, txt)), 1, 13))::BIGINT % {SLOTS})::INT AS v FROM d LEFT JOIN c USING (rid)),
every AS (SELECT i::INT AS v, coalesce(bytes, 0) AS bytes, coalesce(n, 0) AS n FROM range({SLOTS}) r(i) LEFT JOIN (SELECT v, sum(size)::BIGINT AS bytes, count(*) AS n FROM s GROUP BY v) l ON l.v = i),
o AS (SELECT row_number() OVER (ORDER BY bytes DESC, v) - 1 AS i, v, bytes FROM every),
deal AS (SELECT 0::BIGINT AS i, [{{'b': 0::BIGINT, 's': 0, 'k': k::INT}} for k in range({SHARDS})] AS st, -1 AS v, -1 AS shard
 UNION ALL SELECT deal.i + 1, list_transform(st, lambda x: CASE WHEN x.k = list_sort(st)[1].k THEN {{'b': x.b + o.bytes, 's': x.s + 1, 'k': x.k}} ELSE x END), o.v, list_sort(st)[1].k FROM deal JOIN o ON o.i = deal.i),
base AS (SELECT v, shard, coalesce(sum(n) OVER (PARTITION BY shard ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM deal JOIN every USING (v))
SELECT doc_id, size, text_crc32, v AS virtual_slot, shard, base + row_number() OVER (PARTITION BY v ORDER BY doc_id, text_crc32, size) - 1 AS slot, 'bytes' AS law, NULL::INT AS grown_shard FROM s JOIN base USING (v)"""

#: Bytes as two hex digits; a byte goes if a string that covers it has an earlier equal.
SUFFIX_DEDUP = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(coalesce(text, '')) AS h FROM documents),
s AS (SELECT r, doc_id, unnest(range(length(h) // 2 - {LENGTH - 1})) AS i, unnest(list_transform(range(length(h) // 2 - {LENGTH - 1}), lambda i: md5(substr(h, 2 * i + 1, {2 * LENGTH})))) AS k FROM d),
x AS (SELECT r, unnest(range(length(h) // 2)) AS i, unnest(list_transform(range(length(h) // 2), lambda i: substr(h, 2 * i + 1, 2))) AS x FROM d),
o AS (SELECT r, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM s),
b AS (SELECT x.r, x.i, x, max(CASE WHEN again THEN o.i END) OVER (PARTITION BY x.r ORDER BY x.i) AS last FROM x LEFT JOIN o ON o.r = x.r AND o.i = x.i),
m AS (SELECT r, i, x, coalesce(i - last < {LENGTH}, false) AS gone FROM b),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS opens FROM m),
k AS (SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(x, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""

DEBRUIJN = rf"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, doc_id, i, md5(array_to_string(w[i + 1 : i + {WINDOW}], ' ')) AS h FROM w, unnest(range(len(w) - {WINDOW - 1})) u(i)),
o AS (SELECT r, i, doc_id > min(doc_id) OVER (PARTITION BY h) AS again FROM s),
g AS (SELECT DISTINCT r, i + j AS i FROM o, range({WINDOW}) t(j) WHERE again),
k AS (SELECT u.r, string_agg(x, ' ' ORDER BY u.i) FILTER (g.i IS NULL) AS kept, count(g.i) AS n_removed FROM (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS i FROM w) u LEFT JOIN g ON g.r = u.r AND g.i = u.i GROUP BY u.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (r)"""


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Phrases of two and three words, as the contract has them.
COLLOCATIONS = rf"""WITH p AS (SELECT row_number() OVER () AS id, lang, x FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_FOLD.format("coalesce(text, '')")}, '[.,;:!?\n\x0b\f\r]')) AS x FROM documents)),
w AS (SELECT id, lang, list_filter(regexp_split_to_array(x, '[ \t]+'), lambda y: y <> '') AS w FROM p),
g AS (SELECT lang, m, w[i : i + m - 1] AS g FROM w, (VALUES (1), (2), (3)) s(m), unnest(generate_series(1, len(w) - m + 1)) u(i)),
f AS (SELECT lang, m, g, count(*) AS f FROM g GROUP BY lang, m, g),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE m > 1 AND f >= {LEAST}),
s AS (SELECT c.lang, c.m, c.g, c.f AS a, k, x.f AS l, y.f AS r, (({SCORE_SCALE}::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f))::BIGINT AS score FROM c, unnest(generate_series(1, c.m - 1)) u(k) JOIN f x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1 : c.m]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
o AS (SELECT lang, g[i : i + 1] AS g, max(f) AS f FROM c, (VALUES (1), (2)) u(i) WHERE m = 3 GROUP BY 1, 2),
k AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN o ON o.lang = b.lang AND o.g = b.g WHERE o.f IS NULL OR 100 * o.f < {SHARE} * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k) JOIN n USING (lang) WHERE rank <= {TOP}"""


def _vector_codes() -> str:
    """Assignment to all entries, written out round by round."""
    near = """a{n} AS (SELECT r, part, arg_min(entry, (away, entry)) AS entry, min(away) AS away FROM (SELECT p.r, p.part, b.entry, list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))::BIGINT AS away FROM p JOIN b{n} b USING (part)) GROUP BY r, part)"""
    moved = """m{n} AS (SELECT part, entry, list(v ORDER BY i) AS x FROM (SELECT part, entry, i, floor(sum(c)::HUGEINT / count(*))::BIGINT AS v FROM (SELECT a.part, a.entry, i, p.x[i] AS c FROM a{n} a JOIN p USING (r, part), range(1, len(p.x) + 1) s(i)) GROUP BY part, entry, i) GROUP BY part, entry),
b{m} AS (SELECT part, entry, coalesce(m{n}.x, b{n}.x) AS x FROM b{n} LEFT JOIN m{n} USING (part, entry))"""
    rounds = ",\n".join(f"{near.format(n=n)},\n{moved.format(n=n, m=n + 1)}" for n in range(ROUNDS))
    return f"""WITH k AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS x FROM k, range({PARTS}) t(part)),
b0 AS (SELECT part, r - 1 AS entry, x FROM p WHERE r <= {ENTRIES}),
{rounds},
{near.format(n=ROUNDS)},
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS}),
c AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(away)::BIGINT AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM k JOIN c USING (r), h"""


#: The map of eight shards, and the slots of each that go to a ninth.
GROWTH = (
    SHARDING[: SHARDING.index("\nbase AS")]
    + f"""
parts AS (SELECT deal.v, shard, bytes, coalesce(sum(bytes) OVER (PARTITION BY shard ORDER BY md5(deal.v::VARCHAR), deal.v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(bytes) OVER (PARTITION BY shard) AS load FROM deal JOIN every USING (v))
SELECT doc_id, size, text_crc32, s.v AS virtual_slot, shard, CASE WHEN before + bytes <= load::DOUBLE / {SHARDS + 1} THEN {SHARDS} ELSE shard END::INT AS grown_shard FROM s JOIN parts USING (v)"""
)

ORACLES = {"op1_sharding": SHARDING, "shard_growth": GROWTH, "chat_call_order": CALL_ORDER, "op5_chat": CHAT, "op2_quality_rules": QUALITY_RULES, "op4_suffix_dedup": SUFFIX_DEDUP, "op11_vector_codes": _vector_codes(), "op12_debruijn_dedup": DEBRUIJN, "op13_collocations": COLLOCATIONS}
