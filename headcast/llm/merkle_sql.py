"""The Merkle manifest of ``documents`` as SQL: one recursion per tree, one that folds proofs, and crc32 from its polynomial."""

from __future__ import annotations

from headcast.llm.merkle import FIELDS


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _climb(name: str, leaves: str) -> str:
    return f"""{name} AS (SELECT tree, CAST(0 AS BIGINT) AS lvl, pos, n, h FROM {leaves} UNION ALL
      SELECT tree, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY tree, lvl, pos // 2, n)"""


def manifest_sql() -> str:
    leaf = " || ".join(map(_field, FIELDS))
    altered = " || ".join(_field(f"{c} + 1" if c == "n_chars" else c) for c in FIELDS)
    crc = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(s) + 1), lambda j: CAST(ascii(substr(s, j, 1)) AS BIGINT))),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), CAST(4294967295 AS BIGINT))"""
    return f"""WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END)) AS t),
      rows AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS tree, sha256({leaf}) AS h,
        CASE WHEN n_chars IS NOT NULL AND ({crc}) % 7 = 0 THEN sha256({altered}) END AS altered FROM (SELECT *, CAST(doc_id AS VARCHAR) AS s FROM documents), bits),
      leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM rows),
      {_climb("low", "leaves")},
      subs AS (SELECT tree AS own, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, 0 AS tree FROM low WHERE n = 1),
      {_climb("high", "subs")},
      ends AS (SELECT l.doc_id, l.tree, l.pos, l.h AS leaf, coalesce(l.altered, l.h) AS now, s.h AS subroot, s.pos AS place, (SELECT h FROM high WHERE n = 1) AS root FROM leaves l JOIN subs s ON s.own = l.tree),
      steps AS (SELECT e.tree, e.pos, u.lvl, s.h, xor(e.pos >> u.lvl, 1) < (e.pos >> u.lvl) AS before, u.lvl AS k FROM ends e JOIN (SELECT DISTINCT tree, lvl FROM low WHERE n > 1) u USING (tree) LEFT JOIN low s ON s.tree = e.tree AND s.lvl = u.lvl AND s.pos = xor(e.pos >> u.lvl, 1)
        UNION ALL SELECT e.tree, e.pos, u.lvl, s.h, xor(e.place >> u.lvl, 1) < (e.place >> u.lvl), 1000 + u.lvl FROM ends e, (SELECT DISTINCT lvl FROM high WHERE n > 1) u LEFT JOIN high s ON s.lvl = u.lvl AND s.pos = xor(e.place >> u.lvl, 1)),
      path AS (SELECT *, row_number() OVER (PARTITION BY tree, pos ORDER BY k) AS i FROM steps),
      fold AS (SELECT tree, pos, CAST(0 AS BIGINT) AS i, now AS h FROM ends UNION ALL
        SELECT f.tree, f.pos, p.i, sha256(CASE WHEN p.h IS NULL THEN f.h WHEN p.before THEN p.h || f.h ELSE f.h || p.h END) FROM fold f JOIN path p ON p.tree = f.tree AND p.pos = f.pos AND p.i = f.i + 1),
      folded AS (SELECT tree, pos, arg_max(h, i) AS folded_root FROM fold GROUP BY tree, pos),
      proofs AS (SELECT tree, pos, string_agg(h, '' ORDER BY i) AS proof FROM path GROUP BY tree, pos)
      SELECT e.doc_id, e.leaf, e.subroot, e.root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.folded_root, f.folded_root = e.root AS verified
      FROM ends e JOIN folded f USING (tree, pos) LEFT JOIN proofs p USING (tree, pos)"""
