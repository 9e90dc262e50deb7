"""DuckDB SQL for the operators that SQL can express, on the raw tables."""

from __future__ import annotations

from paylens.llm.mixing import ODD_CHARS
from paylens.llm.multiset_hash import LEVELS, SPARSE, SPARSE_BITS, SPOT_HEX, SPOTS, WIDE, WIDE_HEX


def _hilbert(bits: int = 4) -> str:
    """Sharding by rank along the curve: the curve index one bit and axis at a time."""
    axes = range(4)
    steps, last = [], "s0"
    for b in range(bits - 1, 0, -1):
        q = 1 << b
        for i in axes:
            name = f"s{len(steps) + 1}"
            swap = f"(xor(x0, x{i}) & {q - 1})"
            first = f"CASE WHEN x{i} & {q} <> 0 THEN xor(x0, {q - 1}) ELSE xor(x0, {swap}) END AS x0"
            other = f", CASE WHEN x{i} & {q} <> 0 THEN x{i} ELSE xor(x{i}, {swap}) END AS x{i}" if i else ""
            steps.append(f"{name} AS (SELECT * REPLACE ({first}{other}) FROM {last})")
            last = name
    flips = ", ".join(f"(CASE WHEN g3 & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END)" for b in range(bits - 1, 0, -1)).split(", ")
    flip = flips[0]
    for f in flips[1:]:
        flip = f"xor({flip}, {f})"
    index = " + ".join(
        f"((xor(g{i}, t) >> {b}) & 1) * {1 << (b * 4 + 3 - i)}" for b in range(bits - 1, -1, -1) for i in axes
    )
    number = "('0x' || rpad(substr(hex(encode({c})), {c}_skip + 1, 12), 12, '0'))::BIGINT::DOUBLE"
    cell = "coalesce(least(15, greatest(0, floor(({v} - {lo}) / ({hi} - {lo} + 1.0) * 16)::INT)), 15)"
    bounds = []
    for c in ("source", "lang"):
        bounds.append(f"min({c}) AS {c}_min, max({c}) AS {c}_max")
    texts = ", ".join(
        f"coalesce((SELECT max(2 * i) FROM range(0, 1000) r(i) WHERE 2 * i <= least(length(hex(encode({c}_min))), length(hex(encode({c}_max))))"
        f" AND left(hex(encode({c}_min)), 2 * i) = left(hex(encode({c}_max)), 2 * i)), 0) AS {c}_skip"
        for c in ("source", "lang")
    )
    scaled = ", ".join(
        cell.format(
            v=number.format(c=c), lo=number.format(c=c).replace(f"encode({c})", f"encode({c}_min)"),
            hi=number.format(c=c).replace(f"encode({c})", f"encode({c}_max)"),
        )
        + f" AS x{i}"
        for i, c in enumerate(("source", "lang"))
    )
    return f"""
WITH crc_table AS (
  SELECT i, list_reduce(list_concat([i], range(1, 9)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM range(0, 256) r(i)
), crcs AS (SELECT list(c ORDER BY i) AS t FROM crc_table),
sized AS (
  SELECT doc_id, source, lang, strlen(coalesce(text, '')) + 8 AS size,
    xor(list_reduce(list_concat([4294967295::BIGINT], [('0x' || x)::BIGINT FOR x IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')]),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, crcs
), ends AS (SELECT {', '.join(bounds)}, min(doc_id)::DOUBLE AS id_min, max(doc_id)::DOUBLE AS id_max FROM documents),
bounds AS (SELECT *, {texts} FROM ends),
s0 AS (
  SELECT doc_id, size, text_crc32, {scaled},
    {cell.format(v='doc_id::DOUBLE', lo='id_min', hi='id_max')} AS x2,
    least(15, length(ltrim(bin(greatest(size, 8)), '0')) - 4)::INT AS x3
  FROM sized, bounds
), {', '.join(steps)},
gray AS (SELECT *, x0 AS g0, xor(x0, x1) AS g1, xor(xor(x0, x1), x2) AS g2, xor(xor(xor(x0, x1), x2), x3) AS g3 FROM {last}),
flipped AS (SELECT *, {flip} AS t FROM gray),
placed AS (
  SELECT *, {index} AS curve_index, count(*) OVER () AS n FROM flipped
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY curve_index, doc_id NULLS FIRST, size, text_crc32) - 1 AS pos FROM placed
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (pos * 24 // n)::INT AS shard,
  pos - ((pos * 24 // n) * n + 23) // 24 AS slot, NULL::INT AS grown_shard, curve_index::BIGINT AS curve_index
FROM ranked"""


def _multiset() -> str:
    wide = ", ".join(
        f"coalesce(sum(('0x' || substr(h, {1 + i * WIDE_HEX}, {WIDE_HEX}))::BIGINT) & {(1 << 4 * WIDE_HEX) - 1}, 0)::BIGINT" for i in range(WIDE)
    )
    spots = ", ".join(
        f"coalesce(sum(('0x' || substr(h, 59, {SPOT_HEX}))::BIGINT) FILTER (('0x' || substr(h, 57, 2))::BIGINT % {SPOTS} = {s}) & {(1 << 4 * SPOT_HEX) - 1}, 0)::BIGINT"
        for s in range(SPOTS)
    )

    paragraphs = """SELECT body, sha256(p) AS h FROM (
    SELECT body, unnest(string_split(regexp_replace(body, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10))) AS p FROM bodies) WHERE p <> ''"""
    part = "('0x' || substr(h, {}, " + str(WIDE_HEX) + "))::BIGINT"
    low, top = (1 << SPARSE_BITS) - 1, 1 << LEVELS - 1
    text = "array_to_string([lpad(lower(to_hex({v}[i])), CASE WHEN i <= {w} THEN {l} ELSE {s} END, '0') FOR i IN range(1, {e} + 1)], '')"
    shape = {"w": WIDE, "e": WIDE + SPOTS, "l": WIDE_HEX, "s": SPOT_HEX}
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body, length(coalesce(text, '')) AS n FROM documents),
paired AS (
  SELECT *, coalesce(lead(body) OVER (ORDER BY doc_id DESC), first_value(body) OVER (ORDER BY doc_id DESC)) AS next_body FROM d
), edits AS (
  SELECT *, substr(body, 1, n - n // 3) || CASE WHEN n // 3 > 0 THEN substr(next_body, 1, n // 3) ELSE '' END AS edited FROM paired
), bodies AS (SELECT body FROM edits UNION SELECT edited FROM edits),
p AS ({paragraphs}),
prints AS (
  SELECT o.body, list_concat([{wide}], [{spots}]) AS v FROM bodies o LEFT JOIN p ON o.body = p.body GROUP BY o.body
), placed AS (
  SELECT body, {part.format(1)} | {top} AS bits, {part.format(1 + WIDE_HEX)} & {SPARSE - 1} AS spot, {part.format(1 + 2 * WIDE_HEX)} & {low} AS value FROM p
), lanes AS (
  SELECT body, bit_count((bits & -bits) - 1)::INT AS level, spot, count(*) AS c, sum(value)::HUGEINT & {low} AS v FROM placed GROUP BY body, level, spot
), pairs AS (SELECT body AS a, edited AS b FROM edits UNION SELECT body, next_body FROM edits),
turned AS (
  SELECT a, b, level, spot, c, v, c AS t FROM pairs JOIN lanes ON body = a
  UNION ALL SELECT a, b, level, spot, -c, -v, c FROM pairs JOIN lanes ON body = b
), lane AS (
  SELECT a, b, level, sum(t) AS t, CASE WHEN sum(c) <> 0 THEN abs(sum(c)) WHEN sum(v) % {1 << SPARSE_BITS} <> 0 THEN 2 ELSE 0 END AS x FROM turned GROUP BY a, b, level, spot
), by_level AS (SELECT a, b, level, sum(t) AS t, sum(x)::DOUBLE AS x, count_if(x > 0) AS used FROM lane GROUP BY a, b, level),
base AS (
  SELECT a, b, sum(t)::DOUBLE AS total, least(max(CASE WHEN used > {SPARSE // 4} THEN level + 1 ELSE 0 END), {LEVELS - 1}) AS k FROM by_level GROUP BY a, b
), sparse AS (SELECT a, b, total, k, coalesce(sum(x) FILTER (level >= k), 0) AS seen FROM base JOIN by_level USING (a, b) GROUP BY a, b, total, k),
guess AS (
  SELECT s.a, s.b, any_value(total) AS total, any_value(seen) + coalesce(sum(greatest(coalesce(x, 0), seen * pow(2.0, s.k - j - 1))), 0) AS differ
  FROM (SELECT *, unnest(CASE WHEN k > 0 THEN range(0, k) ELSE [NULL] END) AS j FROM sparse) s
  LEFT JOIN by_level l ON l.a = s.a AND l.b = s.b AND l.level = s.j GROUP BY s.a, s.b
), likes AS (
  SELECT p.a, p.b, CASE WHEN total IS NULL THEN 1.0 ELSE greatest(0.0, total - differ) / (total + differ) END::DOUBLE AS near FROM pairs p LEFT JOIN guess g ON g.a = p.a AND g.b = p.b
)
SELECT e.doc_id, e.n::BIGINT AS n_chars, sha256(e.edited) AS edited_sha256,
  {text.format(v='x.v', **shape)} AS fingerprint, {text.format(v='y.v', **shape)} AS edited_fingerprint, l.near AS near_edited, m.near AS near_next
FROM edits e JOIN prints x ON x.body = e.body JOIN prints y ON y.body = e.edited
JOIN likes l ON l.a = e.body AND l.b = e.edited JOIN likes m ON m.a = e.body AND m.b = e.next_body"""


EXACT = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = first_value(doc_id) OVER best AS kept, sha256(norm) AS text_sha256
FROM d WINDOW best AS (PARTITION BY norm ORDER BY n DESC, doc_id)"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS sha, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INT, 1) FOR k IN range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM h"""

NEAR = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS g FROM d
), x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE least(a.n, b.n) * 100 >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_id AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT doc_id, len(g)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM s JOIN least_id ON a = doc_id"""

MIX = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
      / greatest(0.05::DOUBLE + 0.95::DOUBLE * length(translate(coalesce(text, ''), '{ODD_CHARS}', '')) / greatest(length(coalesce(text, '')), 1), 0.000001) AS key,
    md5(coalesce(text, '')) AS tie
  FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s
), o AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_before,
    sum(weight) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_from,
    sum(source_size) OVER () * 1.5::DOUBLE AS total FROM w
), l AS (SELECT *, (total - caps_before) / weight_from AS level FROM o),
f AS (SELECT max(level) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT l.source, l.source_size, least(cap, coalesce(f.level * weight, cap)) AS target FROM l, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
r AS (
  SELECT d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST, d.size, d.tie ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN rest > 0 AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r"""

REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
g AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 49, 0))) AS p FROM d)),
m AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT g.doc_id, g.p FROM g JOIN m ON g.s = m.s AND m.first < g.doc_id),
cut AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM cut),
span AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM run GROUP BY doc_id, run),
gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS kept_from FROM span),
sums AS (
  SELECT d.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
    string_agg(substr(h, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM gap JOIN d USING (doc_id) GROUP BY d.doc_id
)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id)"""

#: DuckDB has no crc32: its table, and the sum over the bytes of a text.
_CRC_TABLE = """crc_table AS (
  SELECT i, list_reduce(list_concat([i], range(1, 9)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM range(0, 256) r(i)
), crcs AS (SELECT list(c ORDER BY i) AS t FROM crc_table)"""
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], [('0x' || x)::BIGINT FOR x IN regexp_extract_all(hex(encode({})), '..')]),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""

CONVERSATIONS = rf"""
WITH RECURSIVE {_CRC_TABLE},
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fault
  FROM conversations, crcs
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(0, CASE WHEN fault = 3 THEN 2 ELSE 1 END)) FROM keyed WHERE fault <> 0)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS x,
    right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS z FROM damaged
), judged AS (
  SELECT *, CASE WHEN z = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN z NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS f,
    coalesce(lag(x) OVER (PARTITION BY conv_id ORDER BY i) || x NOT IN ('su', 'ua', 'au'), false) AS odd FROM placed
), counts AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(f = 'blank') AS blank,
    count_if(f = 'duplicate') AS duplicate, count_if(f = 'truncated') AS truncated, count_if(odd) AS illegal FROM judged GROUP BY conv_id
), adds(s, t, said) AS (VALUES (0, 2, 'user:'), (1, 2, 'user:'), (2, 3, 'assistant:'), (3, 2, 'user:')),
keeps(x, s, t) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
hops AS (
  SELECT s, s AS t, 0 AS c, '' AS w, []::VARCHAR[] AS said FROM adds
  UNION ALL SELECT s, t, 3, 'I', [said] FROM adds
  UNION ALL SELECT a.s, b.t, 6, 'II', [a.said, b.said] FROM adds a JOIN adds b ON a.t = b.s
), edits AS (
  SELECT j.conv_id, j.i, s, s AS t, 4 AS c, 'D' AS w, []::VARCHAR[] AS said FROM judged j, (SELECT DISTINCT s FROM adds)
  UNION ALL SELECT j.conv_id, j.i, s, t, 3 * (f = 'truncated')::INT, 'K', [role || ':' || text] FROM judged j JOIN keeps k ON k.x = j.x WHERE f IN ('', 'truncated')
  UNION ALL SELECT j.conv_id, j.i, s, t, 3 + 3 * (f = 'truncated')::INT, 'R', [said || text] FROM judged j, adds WHERE f IN ('', 'truncated')
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS s, {{'c': 0, 'w': '', 'said': []::VARCHAR[]}} AS best FROM counts
  UNION ALL
  SELECT p.conv_id, p.i + 1, e.t, min({{'c': p.best.c + h.c + e.c, 'w': p.best.w || h.w || e.w, 'said': list_concat(p.best.said, h.said, e.said)}})
  FROM walk p JOIN hops h ON h.s = p.s JOIN edits e ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.i = p.i + 1 AND e.s = h.t
  GROUP BY p.conv_id, p.i, e.t
), ends AS (
  SELECT p.conv_id, min({{'c': p.best.c + h.c, 'w': p.best.w || h.w, 'said': list_concat(p.best.said, h.said)}}) AS best
  FROM walk p JOIN counts n ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND n.n = p.i JOIN hops h ON h.s = p.s AND (h.t = 3 OR h.t = 0)
  GROUP BY p.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
  coalesce(best.w, '') AS audit, sha256(coalesce(array_to_string(best.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM o.conv_id"""


def _codes(rounds: int = 6) -> str:
    """Codebooks by full assignment in every round."""

    def assigned(i: int) -> str:
        return f"""a{i} AS MATERIALIZED (
  SELECT r, p, min(d * 16 + e) AS de FROM (SELECT r, p, e, sum((x.v - c{i}.v) * (x.v - c{i}.v))::BIGINT AS d FROM x JOIN c{i} USING (p, j) GROUP BY r, p, e) GROUP BY r, p
)"""

    def averaged(i: int) -> str:
        return f"""c{i + 1} AS MATERIALIZED (
  SELECT p, e, j, coalesce((s - ((s % n) + n) % n) // n, v)::BIGINT AS v FROM c{i} LEFT JOIN (
    SELECT p, de % 16 AS e, j, sum(v)::BIGINT AS s, count(*) AS n FROM x JOIN a{i} USING (r, p) GROUP BY ALL
  ) USING (p, e, j)
)"""

    steps = ", ".join(s for i in range(rounds) for s in (assigned(i), averaged(i)))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT r, i // (n // 8) AS p, i % (n // 8) AS j, floor(embedding[i + 1]::DOUBLE * 4096)::BIGINT AS v
  FROM (SELECT r, embedding, len(embedding) AS n, unnest(range(0, len(embedding))) AS i FROM kept)
), c0 AS (SELECT p, r AS e, j, v FROM x WHERE r < 16), {steps}, {assigned(rounds)},
coded AS (
  SELECT r, string_agg(lpad(lower(to_hex((de % 16)::BIGINT)), 2, '0'), '' ORDER BY p) AS code, sum(de // 16)::BIGINT AS error FROM a{rounds} GROUP BY r
), books AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), books"""


ORACLE: dict[str, str] = {
    "op1_hilbert_shards": _hilbert(),
    "op2_multiset_hash": _multiset(),
    "op3_content_sort": EXACT,
    "op5_wacz": WARC,
    "op6_hamming_join": NEAR,
    "op7_mixing": MIX,
    "op9_suffix_levels": REPEATS,
    "op12_hirschberg": CONVERSATIONS,
    "op13_drake_hamerly": _codes(),
}
