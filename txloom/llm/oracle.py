"""SQL (DuckDB) of the registered queries that it can express.

Written apart from the operators: brute force where they prune, joins where they sweep. The
tree of URL templates, the language models and the tokenizer are tested otherwise.
"""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+')"

_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 64)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score
  FROM scored
)
SELECT * FROM ranked WHERE rank <= 20
"""

_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same,
         CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 100 = 0
), own AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM own JOIN scored USING (anchor_id)
WHERE NOT same AND 100 * score BETWEEN 80 * positive_score AND 100 * positive_score
QUALIFY rank <= 5
"""

# Strong and weak patterns with their kind; the last column is what a match must contain.
_ASSIGN = """((?i:password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_VALUE = """["'']?\\x20*[:=]\\x20*["'']?"""
_KINDS = [
    ("assign", 0, _ASSIGN),
    ("access", 1, "AKIA[A-Z0-9]{16,}"),
    ("hex", 2, "[0-9a-f]{24,}"),
    ("identifier", 3, rf"\b(?i:user(?:_?name)?|login|client_?id|access_?key_?id|account_?id){_VALUE}[A-Za-z0-9._@-]{{3,}}"),
    ("secret", 4, "[A-Za-z0-9+_-]{16,}"),
    ("endpoint", 5, rf"\b(?i:host(?:name)?|endpoint|server|base_?url){_VALUE}[A-Za-z0-9][A-Za-z0-9.:/-]{{3,}}"),
]


def _matches(name: str, number: int, pattern: str) -> str:
    pattern_sql = f"'{pattern}'"
    return f"""
  SELECT doc_id, {number} AS kind, '{name}' AS name, m,
         CAST(sum(length(piece)) OVER w + coalesce(sum(length(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM (
    SELECT doc_id, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS piece
    FROM (SELECT doc_id, regexp_extract_all(text, {pattern_sql}) AS ms, string_split_regex(text, {pattern_sql}) AS ps FROM documents)
  ) WINDOW w AS (PARTITION BY doc_id ORDER BY i)"""


_SECRETS = (
    "WITH found AS ("
    + "\n  UNION ALL".join(_matches(*kind) for kind in _KINDS)
    + f"""
), parts AS (
  SELECT doc_id, kind, name, start, start + length(m) AS stop,
         CASE WHEN kind IN (1, 3) THEN 'i' WHEN kind = 5 THEN 'e' ELSE 's' END AS role
  FROM found
  WHERE CASE kind WHEN 0 THEN length(regexp_extract(m, '{_ASSIGN}', 2)) >= 6
                  WHEN 4 THEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')
                  ELSE true END
), apart AS (
  SELECT * FROM parts w
  WHERE kind <> 4 OR NOT EXISTS (
    SELECT 1 FROM parts b WHERE b.doc_id = w.doc_id AND b.kind < 3 AND b.start < w.stop AND w.start < b.stop)
), near AS (
  SELECT w.doc_id, w.kind, w.start, w.stop,
         bool_or(o.role = 's') AS s, bool_or(o.role = 'i') AS i
  FROM apart w JOIN apart o ON o.doc_id = w.doc_id
   AND (o.kind, o.start) <> (w.kind, w.start)
   AND o.start - w.stop <= 200 AND w.start - o.stop <= 200
  WHERE w.kind >= 3
  GROUP BY ALL
), linked AS (
  SELECT a.* FROM apart a LEFT JOIN near n USING (doc_id, kind, start)
  WHERE a.kind < 3 OR (a.kind = 3 AND n.s) OR (a.kind = 4 AND n.i) OR (a.kind = 5 AND n.s AND n.i)
), digests AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
         count(*) FILTER (kind = 2) AS n_hex,
         coalesce(string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 3), '') AS base,
         string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans
  FROM linked GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN digests USING (doc_id)
"""
)

_BLANK = "[\\t-\\r ]"
_TEXT = "coalesce(html, '')"
for _pattern, _by in [
    (r"(?s)<!--.*?(-->|\z)", " "),
    *[(rf"(?is)<{e}\b[^>]*>.*?(</{e}{_BLANK}*>|\z)", " ") for e in ("script", "style", "noscript", "template")],
    (f"{_BLANK}+", " "),
    (
        r"(?i)</?(address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main"
        r"|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>",
        "' || chr(10) || '",
    ),
    (r"</?[A-Za-z!][^>]*>", ""),
]:
    _TEXT = f"regexp_replace({_TEXT}, '{_pattern}', '{_by}', 'g')"
for _entity, _character in [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&"),
]:
    _TEXT = f"replace({_TEXT}, '{_entity}', '{_character}')"
_TEXT = f"regexp_replace({_TEXT}, ' *\\n[ \\n]*', chr(10), 'g')"
_TEXT = f"regexp_replace({_TEXT}, '\\A[ \\n]+|[ \\n]+\\z', '', 'g')"


def _urn(*parts: str) -> str:
    joined = " || chr(1) || ".join(f"coalesce(CAST({p} AS VARCHAR), chr(0))" for p in parts)
    h = f"sha256({joined})"
    return (
        f"('<urn:uuid:' || {h}[1:8] || '-' || {h}[9:12] || '-5' || {h}[14:16] || '-8' || {h}[18:20] || '-' || {h}[21:32] || '>')"
    )


def _line(name: str, value: str) -> str:
    return f"coalesce('{name}: ' || regexp_replace(CAST({value} AS VARCHAR), '[\\r\\n]+', ' ', 'g') || e'\\r\\n', '')"


_WARC = f"""
WITH source AS (
  SELECT page_id, url, coalesce(html, '') AS payload, {_TEXT} AS text,
         trim(regexp_replace(regexp_extract(coalesce(html, ''), '(?is)<title\\b[^>]*>(.*?)</title', 1), '{_BLANK}+', ' ', 'g'), ' ') AS title,
         e'HTTP/1.1 200 OK\\r\\nContent-Type: text/html; charset=utf-8\\r\\nContent-Length: '
           || strlen(coalesce(html, '')) || e'\\r\\n' AS source_headers,
         {_urn("'response'", "page_id", "url", "coalesce(html, '')")} AS refers_to
  FROM pages
), named AS (
  SELECT *, {_urn("'conversion'", "refers_to")} AS conversion_id, {_urn("'metadata'", "refers_to")} AS metadata_id,
         'sha256:' || sha256(payload) AS source_payload_digest,
         'sha256:' || sha256(source_headers || e'\\r\\n' || payload) AS source_block_digest
  FROM source
), records AS (
  SELECT *, 'conversion' AS record_type, conversion_id AS record_id, 'text/plain' AS content_type, text AS block FROM named
  UNION ALL
  SELECT *, 'metadata', metadata_id, 'application/warc-fields',
         {_line("title", "nullif(title, '')")} || {_line("conversion", "conversion_id")}
         || {_line("source-block-digest", "source_block_digest")} || {_line("source-payload-digest", "source_payload_digest")}
         || regexp_replace(source_headers, '([^\\r\\n]+\\r?\\n?)', 'source-header: \\1', 'g')
  FROM named
), measured AS (
  SELECT *, 'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length,
         '2024-01-31T00:00:00Z' AS date
  FROM records
)
SELECT page_id, record_type, record_id, content_type, block, refers_to, url AS target_uri, date, source_headers,
       source_payload_digest, block_digest, content_length,
       e'WARC/1.1\\r\\n' || {_line("WARC-Type", "record_type")} || {_line("WARC-Record-ID", "record_id")}
       || {_line("WARC-Refers-To", "refers_to")} || {_line("WARC-Target-URI", "url")} || {_line("WARC-Date", "date")}
       || {_line("WARC-Refers-To-Target-URI", "url")} || {_line("WARC-Refers-To-Date", "date")}
       || {_line("WARC-Block-Digest", "block_digest")} || {_line("Content-Type", "content_type")}
       || {_line("Content-Length", "content_length")} AS headers
FROM measured
"""


# The polynomial's remainders of the 16 half bytes.
_HALF_BYTES = []
for _half in range(16):
    for _ in range(4):
        _half = _half >> 1 ^ (0xEDB88320 if _half & 1 else 0)
    _HALF_BYTES.append(_half)


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, half a byte at a time."""
    digit = "strpos('0123456789ABCDEF', {}) - 1"
    byte = f"CAST(({digit.format('x[1]')}) * 16 + {digit.format('x[2]')} AS BIGINT)"
    values = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: {byte})"
    step = "xor({c} >> 4, CAST({t}[({c} & 15) + 1] AS BIGINT))"
    first = step.format(c="xor(c, b)", t=_HALF_BYTES)
    both = step.format(c=first, t=_HALF_BYTES)
    return f"xor(list_reduce({values}, lambda c, b: {both}, 4294967295), 4294967295)"


def _hilbert(dims: int, bits: int) -> str:
    """Steps from cells x0, x1, … to their place on the curve, as a chain of subqueries."""
    rows, q = "cells", 1 << (bits - 1)
    names = [f"x{k}" for k in range(dims)]
    while q > 1:
        for k in range(dims):
            new = dict(zip(names, names))
            flip, swap = f"x{k} & {q} <> 0", f"(xor(x0, x{k}) & {q - 1})"
            new["x0"] = f"CASE WHEN {flip} THEN xor(x0, {q - 1}) ELSE xor(x0, {swap}) END"
            if k:
                new[f"x{k}"] = f"CASE WHEN {flip} THEN x{k} ELSE xor(x{k}, {swap}) END"
            rows = f"(SELECT * REPLACE ({', '.join(f'{e} AS {n}' for n, e in new.items())}) FROM {rows})"
        q >>= 1
    for k in range(1, dims):
        rows = f"(SELECT * REPLACE (xor(x{k}, x{k - 1}) AS x{k}) FROM {rows})"
    fix = "0"
    for b in range(bits - 1, 0, -1):
        fix = f"xor({fix}, CASE WHEN x{dims - 1} & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    rows = f"(SELECT *, {fix} AS fix FROM {rows})"
    index = " + ".join(
        f"((xor(x{k}, fix) >> {b}) & 1) * {1 << (b * dims + dims - 1 - k)}" for b in range(bits) for k in range(dims)
    )
    return f"(SELECT *, CAST({index} AS INTEGER) AS hilbert FROM {rows})"


def _cell(column: str) -> str:
    # Rows before the peers of this one.
    return f"CAST((rank() OVER (ORDER BY {column} NULLS FIRST) - 1) * 16 // count(*) OVER () AS BIGINT)"


_SHARDS = f"""
WITH summed AS (
  SELECT doc_id, lang, source, strlen(coalesce(text, '')) + 1 AS size,
         length(bin(greatest(n_chars, 0))) * 2 + CAST(bin(greatest(n_chars, 0))[2] = '1' AS INTEGER) AS chars,
         {_crc32("coalesce(text, '')")} AS text_crc32
  FROM documents
), cells AS (
  SELECT *, {_cell("lang")} AS x0, {_cell("source")} AS x1, {_cell("chars")} AS x2 FROM summed
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY hilbert, text_crc32, doc_id) - 1 AS place, count(*) OVER () AS n
  FROM {_hilbert(3, 4)}
)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(place * 16 // n AS INTEGER) AS shard,
       CAST(place - (place * 16 // n * n + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, hilbert
FROM ranked
"""

_NEAR = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS shingle
  FROM words
), coded AS (SELECT doc_id, hash(shingle) AS s FROM sets),
sizes AS (SELECT doc_id, count(*) AS n FROM coded GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM coded a JOIN coded b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 85 * (x.n + y.n - c)
), pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS other FROM pairs UNION SELECT r.doc_id, b FROM reach r JOIN pairs ON r.other = a),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
       doc_id = coalesce(component_id, doc_id) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""

_CONTRACT_WORDS = f"coalesce(regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"

_OVERLAP = f"""
WITH items AS (SELECT item_id, {_CONTRACT_WORDS} AS w FROM benchmark),
docs AS (SELECT doc_id, {_CONTRACT_WORDS} AS w FROM documents),
starts AS (SELECT item_id, w, least(13, len(w)) AS l, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, l, w[p:p + l - 1] AS g FROM starts),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS t FROM docs),
places AS (SELECT *, lead(t) OVER (PARTITION BY doc_id ORDER BY p) AS t2, lead(t, 2) OVER (PARTITION BY doc_id ORDER BY p) AS t3 FROM words),
candidates AS (
  SELECT doc_id, p, item_id, l, g FROM places JOIN windows ON t = g[1] AND t2 = g[2] AND t3 = g[3] WHERE l >= 3
  UNION ALL
  SELECT doc_id, p, item_id, l, g FROM places JOIN windows ON t = g[1] WHERE l < 3
), hits AS (
  SELECT DISTINCT doc_id, p, l, item_id FROM candidates JOIN docs USING (doc_id) WHERE w[p:p + l - 1] = g
), covered AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

SQL: dict[str, str] = {
    "op4_norm_bucket_top_k": _TOP_K,
    "op12_hard_negatives": _NEGATIVES,
    "op5_secret_links": _SECRETS,
    "op6_warc_derivatives": _WARC,
    "op7_hilbert_shards": _SHARDS,
    "op9_coordinate_join_dedup": _NEAR,
    "op10_benchmark_overlap": _OVERLAP,
}
