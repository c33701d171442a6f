"""DuckDB SQL of the queries that SQL can express, each from its contract and by brute force."""

from __future__ import annotations


def crc32(text: str) -> str:
    """The unsigned CRC-32 of a short ASCII text, bit by bit."""
    bits = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    chars = f"list_transform(string_split(CAST({text} AS VARCHAR), ''), lambda t: CAST(ascii(t) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {chars}), lambda c, b: {bits}), 4294967295)"


def op11() -> str:
    return f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, item) AS k, item, words FROM (
    SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS item,
           len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
    FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS lender, {crc32('conv_id')} % 4 AS h FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), laid AS (
  SELECT c.conv_id, 0 AS part, t.k, t.item, t.words FROM convs AS c JOIN turns AS t ON t.conv_id = c.lender AND t.k <= c.h
  UNION ALL SELECT c.conv_id, 1, t.k, t.item, t.words FROM convs AS c JOIN turns AS t ON t.conv_id = c.conv_id AND t.k > c.h
), rebuilt AS (
  SELECT conv_id, count(*) OVER w AS depth, string_agg(item, '') OVER w AS prefix, words, count(*) OVER (PARTITION BY conv_id) AS size
  FROM laid WINDOW w AS (PARTITION BY conv_id ORDER BY part, k)
), members AS (
  SELECT conv_id, depth, prefix, words, size FROM rebuilt
  UNION ALL SELECT c.conv_id, 0, '', 0, coalesce(any_value(r.size), 0) FROM convs AS c LEFT JOIN rebuilt AS r USING (conv_id) GROUP BY c.conv_id
), nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
         sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
  FROM members GROUP BY prefix, depth
), kids AS (
  SELECT substr(prefix, 1, 64 * (depth - 1)) AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), known AS (
  SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (prefix)
), below AS (
  SELECT a.prefix, count(*) FILTER (b.n_children = 0) AS n_leaves, sum(b.saved) AS saved_tokens
  FROM known AS b JOIN members AS m ON m.conv_id = b.conv_id AND m.depth <= b.depth JOIN known AS a ON a.prefix = m.prefix GROUP BY a.prefix
)
SELECT k.conv_id, CAST(k.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, k.ends_sha256
FROM known AS k JOIN below USING (prefix) LEFT JOIN known AS up ON k.depth > 0 AND up.prefix = substr(k.prefix, 1, 64 * (k.depth - 1))
"""


def op13(levels: int = 6, over: int = 3) -> str:
    """Trees of up to 16 ** ``levels`` rows a source and 16 ** ``over`` sources."""

    def field(name: str) -> str:
        return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || {name}, '-')"

    head = "||".join(field(x) for x in ("doc_id", "source", "lang", "n_chars"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [f"""
WITH leaves AS (
  SELECT doc_id, source, sha256({head}||{field('text')}) AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {crc32('coalesce(doc_id, 0)')} % 5 = 0 THEN sha256({head}||{field(lower)}) ELSE sha256({head}||{field('text')}) END AS other
  FROM documents
), d0 AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, other AS fold, '' AS proof FROM leaves
), n0 AS (SELECT source AS g, pos, leaf AS h FROM d0)"""]

    def climb(k: int, key: str, nodes: str, docs: str) -> str:
        merged = "CASE WHEN count(*) = 1 AND any_value(size) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END"
        return f"""
r{k} AS (SELECT g, pos // 16 AS pos, list(h ORDER BY pos) AS run, any_value(size) AS size, {merged} AS h FROM (SELECT *, count(*) OVER (PARTITION BY g) AS size FROM {nodes}) GROUP BY g, pos // 16
), n{k + 1} AS (SELECT g, pos, h FROM r{k}
), d{k + 1} AS (
  SELECT d.* REPLACE (d.pos // 16 AS pos,
    CASE WHEN size = 1 THEN fold ELSE sha256(array_to_string(list_concat(run[:d.pos % 16], [fold], run[d.pos % 16 + 2:]), '')) END AS fold,
    proof || array_to_string(list_concat(run[:d.pos % 16], run[d.pos % 16 + 2:]), '') AS proof)
  FROM {docs} AS d JOIN r{k} ON {key} IS NOT DISTINCT FROM g AND d.pos // 16 = r{k}.pos)"""

    parts += [climb(k, "d.source", f"n{k}", f"d{k}") for k in range(levels)]
    parts.append(f"""
tops AS (SELECT g AS name, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos FROM n{levels}
), m0 AS (SELECT CAST(0 AS BIGINT) AS g, pos, h FROM tops
), e0 AS (SELECT d.* REPLACE (tops.pos AS pos), tops.h AS subroot FROM d{levels} AS d JOIN tops ON source IS NOT DISTINCT FROM name)""")
    parts += [climb(levels + 1 + k, "0", f"m0" if not k else f"n{levels + 1 + k}", "e0" if not k else f"d{levels + 1 + k}") for k in range(over)]
    last = levels + 1 + over
    return ",".join(parts) + f"""
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified FROM d{last}, n{last}"""


def op7(rules: dict[str, tuple[str, int, int]], base: int) -> str:
    """Matches of each rule (pattern, group that counts, least length) by splitting the texts; the first ``base`` rules make the digest."""

    def kind(i: int, name: str) -> str:
        pattern, group, least = rules[name]
        quoted = "'" + pattern.replace("'", "''") + "'"
        return (f"SELECT r, {i} AS place, '{name}' AS kind, {least} AS least, regexp_extract_all(t, {quoted}, 0) AS alls, regexp_extract_all(t, {quoted}, {group}) AS owns, "
                f"string_split_regex(t, {quoted}) AS gaps FROM d")

    names = list(rules)
    found = " UNION ALL ".join(kind(i, n) for i, n in enumerate(names))
    text = "string_agg(kind || ':' || (stop - n) || ':' || stop, ',' ORDER BY stop - n, place)"
    counts = ", ".join(f"count(*) FILTER (kind = '{n}') AS n_{n}" for n in names[:base])
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents
), m AS ({found}
), e AS (SELECT r, place, kind, least, unnest(range(len(alls))) AS i, length(unnest(alls)) AS n, length(unnest(owns)) AS own, length(unnest(gaps[:len(alls)])) AS gap FROM m
), p AS (SELECT *, CAST(sum(gap + n) OVER (PARTITION BY r, place ORDER BY i) AS BIGINT) AS stop FROM e
), f AS (SELECT r, {counts}, {text} FILTER (place < {base}) AS base, {text} AS spans FROM p WHERE own >= least GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{n}, 0) AS n_{n}" for n in names[:base])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob
FROM d LEFT JOIN f USING (r)
"""
