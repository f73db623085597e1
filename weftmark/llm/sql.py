"""SQL counterparts of those operators that SQL can express."""

from __future__ import annotations

CLUSTERS, ROUNDS, COMPONENTS = 16, 3, 64


def _centroids() -> str:
    """All rounds, one after the other."""

    def assigned(step: int) -> str:
        return f"""a{step} AS MATERIALIZED (
          SELECT n, vec_id, v, struct_extract(best, 'c') AS c, struct_extract(best, 'd') AS d FROM (
            SELECT k.n, any_value(vec_id) AS vec_id, any_value(k.v) AS v,
              min({{'d': list_sum(list_transform(list_zip(k.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'c': m.c}}) AS best
            FROM kept k CROSS JOIN m{step} m GROUP BY k.n))"""

    def moved(step: int) -> str:
        # floored division of exact sums
        return f"""m{step} AS MATERIALIZED (
          SELECT m.c, coalesce(f.v, m.v) AS v FROM m{step - 1} m LEFT JOIN (
            SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM (
              SELECT c, i, sum(x)::HUGEINT AS s, count(*) AS n FROM (
                SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{step - 1}) GROUP BY c, i) GROUP BY c) f
          ON f.c = m.c)"""

    steps = [assigned(0)]
    for step in range(1, ROUNDS + 1):
        steps += [moved(step), assigned(step)]
    joined = ",\n        ".join(steps)
    return f"""WITH kept AS MATERIALIZED (
          SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
          FROM embeddings WHERE len(embedding) = {COMPONENTS}
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        m0 AS MATERIALIZED (
          SELECT (row_number() OVER (ORDER BY h, v) - 1)::INTEGER AS c, v FROM (
            SELECT sha256('1:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {CLUSTERS})),
        {joined}
      SELECT vec_id, a.c AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia,
        sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
      FROM a{ROUNDS} a JOIN m{ROUNDS} m ON m.c = a.c"""


CENTROIDS = _centroids()


def _crc32(text: str) -> str:
    """Unsigned crc32 of a short ASCII text, with ``crc_table`` (t: list of 256 numbers) in scope."""
    codes = f"list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT)"
    step = "lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), {step}), 4294967295::BIGINT)"


def _crc_table() -> str:
    values = "range(256)"
    for _ in range(8):
        values = f"list_transform({values}, lambda c: xor(c >> 1, 3988292384::BIGINT * (c & 1)))"
    return f"SELECT {values} AS t"


def _merkle() -> str:
    def field(value: str) -> str:
        return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"

    def row_hash(n_chars: str = "n_chars") -> str:
        return "sha256(" + " || ".join(field(v) for v in ("doc_id", "source", "lang", n_chars, "text")) + ")"

    def grown(name: str, start: str) -> str:
        """All nodes of the trees of ``start`` (tree, i, n, h)."""
        return f"""{name}(tree, level, i, n, h) AS (
          SELECT tree, 0, i, n, h FROM {start}
          UNION ALL
          SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1
          GROUP BY tree, level, i // 2, n)"""

    def folded(name: str, start: str, nodes: str) -> str:
        """From every node of ``start`` (doc_id, tree, i, n, h, proof) up, siblings appended to the proof."""
        return f"""{name}(doc_id, tree, i, n, h, proof) AS (
          SELECT doc_id, tree, i, n, h, proof FROM {start}
          UNION ALL
          SELECT f.doc_id, f.tree, f.i // 2, (f.n + 1) // 2,
            sha256(CASE WHEN s.h IS NULL THEN f.h WHEN f.i % 2 = 1 THEN s.h || f.h ELSE f.h || s.h END), f.proof || coalesce(s.h, '')
          FROM {name} f LEFT JOIN {nodes} s ON s.tree = f.tree AND s.n = f.n AND s.i = xor(f.i, 1) WHERE f.n > 1)"""

    return f"""WITH RECURSIVE crc_table AS ({_crc_table()}),
        rows AS MATERIALIZED (
          SELECT doc_id, coalesce('=' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i,
            count(*) OVER (PARTITION BY lang) AS n, {row_hash()} AS leaf,
            CASE WHEN {_crc32("doc_id::VARCHAR")} % 7 = 0 THEN {row_hash("(n_chars + 1)")} ELSE {row_hash()} END AS claim
          FROM documents, crc_table),
        starts AS (SELECT tree, i, n, leaf AS h FROM rows),
        {grown("nodes", "starts")},
        ranked AS (
          SELECT tree AS lang, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, h
          FROM nodes WHERE n = 1),
        {grown("tops", "ranked")},
        claims AS (SELECT doc_id, tree, i, n, claim AS h, '' AS proof FROM rows),
        {folded("climbed", "claims", "nodes")},
        halfway AS (
          SELECT c.doc_id, r.tree, r.i, r.n, c.h, c.proof FROM climbed c JOIN ranked r ON r.lang = c.tree WHERE c.n = 1),
        {folded("ended", "halfway", "tops")}
      SELECT r.doc_id, r.leaf, s.h AS subroot, t.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = t.h AS verified
      FROM rows r JOIN ranked s ON s.lang = r.tree JOIN ended e ON e.doc_id = r.doc_id AND e.n = 1
        JOIN tops t ON t.n = 1"""


MERKLE = _merkle()

_UPPER_CASE, _LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"[^\x20\x09-\x0D]+"

MINHASH = f"""WITH RECURSIVE words AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER_CASE}', '{_LOWER_CASE}'), '{_WORDS}') AS w FROM documents),
  sets AS MATERIALIZED (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM words),
  shingles AS MATERIALIZED (SELECT doc_id, len(s) AS n, md5_number(unnest(s)) AS h FROM sets),
  pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
  reached(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, p.b FROM reached r JOIN pairs p ON p.a = r.other)
  SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
  FROM sets JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) USING (doc_id)"""
