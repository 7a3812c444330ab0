"""Check SQL for the queries of this package that SQL can express."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOW = "translate(coalesce({}, ''), '" + _UPPER + "', '" + _UPPER.lower() + "')"
_TERMS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

REPEATS = """
WITH bytes AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
  SELECT r, i, md5_number(substr(h, CAST(2 * i + 1 AS BIGINT), 800)) AS k FROM bytes, unnest(range(0, length(h) // 2 - 399)) AS t(i)
), repeated AS (
  SELECT k FROM windows GROUP BY k HAVING count(*) > 1
), starts AS (
  SELECT r, i, i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -1000) + 400 AS fresh FROM windows WHERE k IN (SELECT k FROM repeated)
), grouped AS (
  SELECT r, i, count(*) FILTER (fresh) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM starts
), spans AS (
  SELECT r, span, min(i) AS a, max(i) + 400 AS b FROM grouped GROUP BY r, span
), gaps AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM spans
), cut AS (
  SELECT r, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed, max(b) AS last,
    string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS kept
  FROM gaps JOIN bytes USING (r) GROUP BY r
)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM bytes LEFT JOIN cut USING (r)
"""

MIXING = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, sum(size * greatest(1, 1000 // (size + 10))) / greatest(sum(size), 1)::DOUBLE AS mean_like
  FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, mean_like, source_size * 2.0::DOUBLE AS cap,
    [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS weight
  FROM totals
), levels(round, level) AS (
  SELECT 0, CAST(-1.0 AS DOUBLE)
  UNION ALL
  SELECT round + 1, greatest(level, coalesce((
    SELECT (1.5::DOUBLE * sum(source_size) - coalesce(sum(cap) FILTER (cap <= level * weight), 0))
      / nullif(sum(weight) FILTER (NOT cap <= level * weight), 0) FROM weighed), level))
  FROM levels WHERE round < 60
), targets AS (
  SELECT source, source_size, mean_like, least(cap, greatest((SELECT max(level) FROM levels), 0) * weight) AS target FROM weighed
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM targets
), drawn AS (
  SELECT doc_id, size, source_size, target, CAST(floor(ratio) AS BIGINT) AS whole, sized.source,
    CASE WHEN mean_like > 0 THEN (ratio - floor(ratio)) * greatest(1, 1000 // (size + 10)) / mean_like ELSE ratio - floor(ratio) END AS p,
    target - floor(ratio) * source_size AS rest,
    (CAST(('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || size), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized JOIN plan ON sized.source IS NOT DISTINCT FROM plan.source
), ranked AS (
  SELECT *, (u / (1 - u)) / (least(0.999::DOUBLE, p) / (1 - least(0.999::DOUBLE, p))) AS rank FROM drawn WHERE p > 0 AND size > 0
), summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank ROWS UNBOUNDED PRECEDING) AS reached FROM ranked
), decided AS (
  SELECT doc_id, size, source_size, target, whole + CAST(2 * reached - size <= 2 * rest AS BIGINT) AS copies FROM summed
  UNION ALL
  SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN whole ELSE 0 END FROM drawn WHERE NOT (p > 0 AND size > 0)
)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, copies FROM decided
"""

WARC = """
WITH payloads AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), led AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS leader FROM payloads
)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((
    CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS BIGINT)) % 32 + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = leader THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> leader THEN leader END AS refers_to
FROM led
"""

URLS = """
WITH parsed AS (
  SELECT page_id, coalesce(""" + "translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '" + _UPPER + "', '" + _UPPER.lower() + """'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), counted AS (
  SELECT *, count(*) OVER (PARTITION BY host || path) AS n FROM parsed
), ruled AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM counted
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN host || path <> '' AND n > 1 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

CONTAMINATION = f"""
WITH found AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS.format(_LOW.format('text'))} AS w FROM documents
), items AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_TERMS.format(_LOW.format('text'))} AS w FROM benchmark WHERE item_id IS NOT NULL
), patterns AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS p
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0
), windows AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM found, (SELECT DISTINCT n FROM patterns), unnest(range(1, len(w) - n + 2)) AS t(i)
), hits AS (
  SELECT r, i, windows.n, item FROM windows JOIN patterns ON windows.n = patterns.n AND windows.p = patterns.p
), placed AS (
  SELECT r, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(j) GROUP BY r
), owners AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM found LEFT JOIN placed USING (r) LEFT JOIN owners USING (r)
"""


def _framed(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


_ROW = " || ".join(_framed(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "n_chars"))
_TAMPERED = f"translate(text, '{_UPPER}', '{_UPPER.lower()}')"

#: Each byte is followed by eight shifts of the remainder.
_CRC32 = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(
  list_filter(string_split(coalesce(CAST({} AS VARCHAR), ''), ''), lambda c: c <> ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295)"""

#: Levels are grouped by 16 until one node is left; proofs walk up from each row, first to its source's node, then to the root.
MANIFEST = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('s' || source, 'n') AS tree, sha256({_ROW} || {_framed('text')}) AS leaf,
    sha256({_ROW} || {_framed(_TAMPERED)}) AS altered, {_CRC32.format('doc_id')} AS crc FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), levels(tree, level, i, node, n) AS (
  SELECT tree, 0, i, leaf, n FROM placed
  UNION ALL
  SELECT tree, level + 1, i // 16, sha256(string_agg(node, '' ORDER BY i)), max((n + 15) // 16) FROM levels WHERE n > 1 GROUP BY tree, level, i // 16
), tops AS (
  SELECT tree, node AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n FROM levels WHERE n = 1
), upper(level, i, node, n) AS (
  SELECT 0, i, subroot, n FROM tops
  UNION ALL
  SELECT level + 1, i // 16, sha256(string_agg(node, '' ORDER BY i)), max((n + 15) // 16) FROM upper WHERE n > 1 GROUP BY level, i // 16
), final AS (
  SELECT node AS root FROM upper WHERE n = 1
), nodes AS (
  SELECT tree, level, i, node, n FROM levels UNION ALL SELECT '', level, i, node, n FROM upper
), runs AS (
  SELECT tree, level, i // 16 AS run, list(node ORDER BY i) AS members FROM nodes WHERE n > 1 GROUP BY tree, level, i // 16
), walk(r, part, tree, level, i, folded, proof) AS (
  SELECT r, 0, tree, 0, i, CASE WHEN crc % 5 = 0 THEN altered ELSE leaf END, '' FROM placed
  UNION ALL
  SELECT r, 0, walk.tree, walk.level + 1, i // 16,
    sha256(array_to_string(members[:i % 16], '') || folded || array_to_string(members[i % 16 + 2:], '')),
    proof || array_to_string(members[:i % 16], '') || array_to_string(members[i % 16 + 2:], '')
  FROM walk JOIN runs ON walk.tree = runs.tree AND walk.level = runs.level AND i // 16 = run
), risen AS (
  SELECT r, tree, arg_max(folded, level) AS folded, arg_max(proof, level) AS proof FROM walk GROUP BY r, tree
), climb(r, level, i, folded, proof) AS (
  SELECT r, 0, i, folded, proof FROM risen JOIN tops USING (tree)
  UNION ALL
  SELECT r, climb.level + 1, i // 16,
    sha256(array_to_string(members[:i % 16], '') || folded || array_to_string(members[i % 16 + 2:], '')),
    proof || array_to_string(members[:i % 16], '') || array_to_string(members[i % 16 + 2:], '')
  FROM climb JOIN runs ON runs.tree = '' AND climb.level = runs.level AND i // 16 = run
), folds AS (
  SELECT r, arg_max(folded, level) AS folded_root, sha256(arg_max(proof, level)) AS proof_sha256 FROM climb GROUP BY r
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN tops USING (tree) JOIN folds USING (r), final
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_suffix_dedup": REPEATS, "op3_mixing": MIXING, "op4_warc": WARC, "op6_url_filter": URLS, "op9_contamination": CONTAMINATION,
        "op11_manifest": MANIFEST,
    }
