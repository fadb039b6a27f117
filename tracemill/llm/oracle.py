"""DuckDB SQL of the queries that SQL can tell."""

from __future__ import annotations

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _base32(hex_digits: str) -> str:
    """SQL for the base-32 text of 40 hexadecimal digits: groups of 40 bits, five bits a digit."""
    digits = [
        f"substr('{_BASE32}', ((CAST('0x' || substr({hex_digits}, {1 + 10 * group}, 10) AS BIGINT) >> {5 * (7 - i)}) & 31) + 1, 1)"
        for group in range(4)
        for i in range(8)
    ]
    return " || ".join(digits)


WARC = f"""
WITH p AS (
    SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS lowest FROM pages
)
SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, {_base32('sha1(payload)')} AS payload_digest,
    CASE WHEN page_id > lowest THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id > lowest THEN lowest END AS refers_to
FROM p
"""

VECTORS = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), lowest AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, CAST((SELECT count(*) FROM links WHERE links.a = vec_id) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN lowest ON lowest.a = vec_id
"""

URLS = """
WITH u AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
    SELECT page_id,
        translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM u
), r AS (
    SELECT *, CASE
        WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule
    FROM s
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

MIX = r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
        CAST('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), 'n'), ':', coalesce(text, ''))), 1, 9) AS BIGINT) AS place
    FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * sum(size) AS most,
        [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight
    FROM d GROUP BY source
), l AS (
    SELECT *, most / weight AS turn,
        1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER before, 0) AS rest,
        sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weights
    FROM s
    WINDOW before AS (ORDER BY most / weight, coalesce('s' || source, 'n') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
    SELECT source, source_size, least(most, coalesce((SELECT rest / weights FROM l WHERE rest / weights * weight <= most ORDER BY turn, rest / weights LIMIT 1) * weight, most)) AS target
    FROM l
), b AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS turns FROM t
), g AS (
    SELECT d.source, place, sum(size) AS tokens, any_value(target - turns * source_size) AS rest
    FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source GROUP BY d.source, place
), c AS (
    SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY place) AS upto FROM g
), e AS (
    SELECT source, arg_min(CASE WHEN 2 * upto - tokens < 2 * rest THEN place ELSE place - 1 END, place) AS last
    FROM c WHERE upto > rest GROUP BY source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, b.source_size, b.target,
    CAST(size * (turns + CASE WHEN place <= coalesce(last, -1) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""

TRIE = r"""
WITH ids AS (
  SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), bytes AS (
  SELECT conv_id, n, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1])) AS b
  FROM ids
), plan AS (  -- a byte is folded in, then eight bits are shifted out
  SELECT conv_id, conv_id - conv_id % 20 AS base, n,
    xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda a, x: CASE
      WHEN x >= 0 THEN xor(a, x::BIGINT) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT) % 4 AS skip
  FROM bytes
), turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    md5(concat(octet_length(encode(coalesce(role, ''))), ':', coalesce(role, ''), coalesce(text, '')))
  ) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL
), rebuilt AS (
  SELECT p.conv_id, t.place, t.role, t.text FROM plan p JOIN turns t ON t.conv_id = p.base AND t.place < p.skip
  UNION ALL
  SELECT p.conv_id, t.place, t.role, t.text FROM plan p JOIN turns t ON t.conv_id = p.conv_id AND t.place >= p.skip
), numbered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth, md5(concat(length(role), ':', role, text)) AS content,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM rebuilt
), members AS (
  SELECT conv_id, 0 AS depth, '' AS node, 0 AS words FROM ids
  UNION ALL
  SELECT conv_id, depth, string_agg(content, '/') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING), words FROM numbered
), lengths AS (
  SELECT conv_id, max(depth) AS longest FROM members GROUP BY conv_id
), nodes AS (
  SELECT node, depth, min(m.conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    coalesce(string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) FILTER (depth = longest), '') AS ends
  FROM members m JOIN lengths l ON l.conv_id = m.conv_id GROUP BY node, depth
), above AS (  -- every node with every node of its subtree
  SELECT DISTINCT a.node AS node, b.node AS under FROM members a JOIN members b ON a.conv_id = b.conv_id AND a.depth <= b.depth
), parents AS (
  SELECT DISTINCT a.node AS node, b.node AS child FROM members a JOIN members b ON a.conv_id = b.conv_id AND a.depth + 1 = b.depth
), children AS (
  SELECT node, count(*) AS n FROM parents GROUP BY node
), sums AS (
  SELECT a.node, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((u.n_convs - 1) * u.words) AS saved_tokens
  FROM above a JOIN nodes u ON u.node = a.under LEFT JOIN children c ON c.node = a.under GROUP BY a.node
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums s ON s.node = n.node LEFT JOIN children c ON c.node = n.node
LEFT JOIN parents p ON p.child = n.node LEFT JOIN nodes up ON up.node = p.node
"""
