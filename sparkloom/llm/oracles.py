"""SQL (DuckDB) for the rows of those corpus queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT item_id, least(len(w), 13) AS n, w[k:k + least(len(w), 13) - 1] AS g
  FROM i, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, k, n, w[k:k + n - 1] AS g FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS p(k)),
hits AS (SELECT doc_id, item_id, k, n FROM places JOIN windows USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM hits, unnest(range(k, k + n)) AS q(place) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: The checksum is built from its polynomial, as DuckDB has no function for it.
_CRC_TABLE = """steps(byte, n, c) AS (
  SELECT b, 0, CAST(b AS BIGINT) FROM range(256) AS r(b)
  UNION ALL SELECT byte, n + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE n < 8),
lookup AS (SELECT list(c ORDER BY byte) AS t FROM steps WHERE n = 8)"""
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295)"

SHARDING = f"""
WITH RECURSIVE {_CRC_TABLE},
sized AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents),
placed AS (
  SELECT doc_id, size,
    {_CRC} AS text_crc32,
    CAST(least(15, floor(CAST(sum(size) OVER (ORDER BY doc_id) - size + size // 2 AS DOUBLE) * 16 / sum(size) OVER ())) AS INT) AS shard
  FROM sized, lookup)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM placed
"""

NEAR_DEDUP = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS UBIGINT[]) WHEN len(w) < 4 THEN [hash(w)]
    ELSE list_sort(list_distinct([hash(w[i:i + 3]) FOR i IN range(1, len(w) - 2)])) END AS s FROM words),
texts AS (SELECT min(doc_id) AS rep, s FROM sets WHERE len(s) > 0 GROUP BY s),
tokens AS (SELECT rep, len(s) AS n, unnest(s) AS t FROM texts),
links AS (
  SELECT a.rep AS a, b.rep AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.rep < b.rep
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
component AS (SELECT a AS rep, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles,
  CAST(coalesce(c, texts.rep, sets.doc_id) AS BIGINT) AS component_id, sets.doc_id = coalesce(c, texts.rep, sets.doc_id) AS kept
FROM sets LEFT JOIN texts ON sets.s = texts.s LEFT JOIN component ON component.rep = texts.rep
"""


def _centroids(k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """Rounds one after the other, each with its assignment (a) and the centroids after it (c)."""
    ctes = [
        """kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"""seeds AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), q) - 1 AS c, q FROM kept WHERE vec_id IS NOT NULL QUALIFY c < {k})""",
        "v AS (SELECT r, unnest(range(64)) AS i, unnest(q) AS x FROM kept)",
        "c0 AS (SELECT c, unnest(range(64)) AS i, unnest(q) AS x FROM seeds)",
    ]
    for n in range(rounds + 1):
        ctes.append(
            f"""a{n} AS (SELECT r, c, d FROM (SELECT r, c, CAST(sum((v.x - c{n}.x) * (v.x - c{n}.x)) AS BIGINT) AS d FROM v JOIN c{n} USING (i) GROUP BY r, c)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""
        )
        if n < rounds:
            ctes.append(
                f"""c{n + 1} AS (SELECT c, i, coalesce(m, x) AS x FROM c{n} LEFT JOIN (
    SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{n} JOIN v USING (r) GROUP BY c, i)) USING (c, i))"""
            )
    return f"""WITH {", ".join(ctes)},
digests AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN digests USING (c)"""


CENTROIDS = _centroids()


def _repair() -> str:
    """A state is its cost in ten digits and its audit, so that the smaller string is the better one."""

    def plus(state: str, cost: str, letter: str) -> str:
        return f"lpad(CAST(CAST(left({state}, 10) AS BIGINT) + {cost} AS VARCHAR), 10, '0') || substr({state}, 11) || '{letter}'"

    never = "'0999999999'"
    stay = "CASE WHEN fault IN (1, 2) THEN 1000000 WHEN fault = 3 THEN 3 ELSE 0 END"
    keep = lambda state, role: f"CASE WHEN init = '{role}' THEN {plus(state, stay, 'K')} ELSE {never} END"
    reroled = lambda state: plus(state, f"3 + {stay}", "R")
    deleted = {s: plus(f"p.{s}", "4", "D") for s in "esua"}
    to_user = ", ".join(f"{keep(f'p.{s}', 'u')}, {reroled(f'p.{s}')}" for s in "esa")
    return rf"""
WITH RECURSIVE {_CRC_TABLE},
base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(regexp_extract_all(hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes
  FROM conversations),
fates AS (SELECT conv_id, turn, role, text, {_CRC} % 20 AS fate FROM base, lookup),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM fates, unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS u(copy) WHERE fate <> 0),
placed AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS init, row_number() OVER w AS i, lead(left(role, 1)) OVER w AS following, lead(1) OVER w AS more
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text))),
judged AS (
  SELECT conv_id, turn, role, text, init, i, more = 1 AND init || following NOT IN ('su', 'ua', 'au') AS illegal,
    CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 3 ELSE 0 END AS fault
  FROM placed),
convs AS (SELECT DISTINCT conv_id FROM conversations),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
    count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE illegal) AS illegal FROM judged GROUP BY conv_id),
walk(conv_id, i, e, s, u, a) AS (
  SELECT conv_id, CAST(0 AS BIGINT), '0000000000', {never}, '0000000003I', '0000000006II' FROM counted
  UNION ALL
  SELECT conv_id, i, e, s, least(u, {plus("e", "3", "I")}, {plus("s", "3", "I")}, {plus("a", "3", "I")}),
    least(a, {plus(f"least(u, {plus('e', '3', 'I')}, {plus('s', '3', 'I')}, {plus('a', '3', 'I')})", "3", "I")})
  FROM (
    SELECT p.conv_id, j.i, {deleted["e"]} AS e, least({deleted["s"]}, {keep("p.e", "s")}) AS s, least({deleted["u"]}, {to_user}) AS u,
      least({deleted["a"]}, {keep("p.u", "a")}, {reroled("p.u")}) AS a
    FROM walk p JOIN judged j ON p.conv_id IS NOT DISTINCT FROM j.conv_id AND j.i = p.i + 1)),
best AS (SELECT walk.conv_id, CAST(left(least(e, a), 10) AS BIGINT) AS cost, substr(least(e, a), 11) AS audit
  FROM walk JOIN counted ON walk.conv_id IS NOT DISTINCT FROM counted.conv_id AND walk.i = counted.n),
letters AS (SELECT conv_id, audit, k, substr(audit, CAST(k AS INT), 1) AS letter FROM best, unnest(range(1, length(audit) + 1)) AS l(k)),
edits AS (SELECT conv_id, k, letter, count(*) FILTER (WHERE letter <> 'I') OVER w AS i, count(*) FILTER (WHERE letter <> 'D') OVER w AS o
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING)),
turns AS (
  SELECT edits.conv_id, letter, o, role, text, max(CASE WHEN o = 1 AND letter = 'K' AND init = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY edits.conv_id) AS led
  FROM edits LEFT JOIN judged ON edits.conv_id IS NOT DISTINCT FROM judged.conv_id AND edits.i = judged.i WHERE letter <> 'D'),
hashes AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY o)) AS h
  FROM turns GROUP BY conv_id)
SELECT convs.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  coalesce(h, sha256('')) AS repaired_sha256
FROM convs LEFT JOIN counted ON convs.conv_id IS NOT DISTINCT FROM counted.conv_id LEFT JOIN best ON convs.conv_id IS NOT DISTINCT FROM best.conv_id
LEFT JOIN hashes ON convs.conv_id IS NOT DISTINCT FROM hashes.conv_id"""


REPAIR = _repair()
