"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

#: CRC-32 over a list of bytes, its table built by rule.
_CRC_TABLE = "(SELECT list(t ORDER BY i) FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS t FROM range(256) r(i)))"


def _crc(of: str, table: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {of}), lambda c, b: xor(c // 256, {table}[xor(c % 256, b) + 1])), 4294967295)"


_LOWER = f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')"
#: Sixteen to this power is the number of rows that the SQL can hold.
_LEVELS = 8


def _tree(name: str, group: str, nodes: str, payload: str) -> list[str]:
    """CTEs {name}_run0 and so on over nodes (group, idx, n, digest, payload), and {name}_top with the group's last digest."""
    out, level = [], nodes
    for k in range(_LEVELS):
        out.append(f"{name}_run{k} AS MATERIALIZED (SELECT {group}, n, idx // 16 AS up, list(digest ORDER BY idx) AS kids, CASE n WHEN 1 THEN min(digest) ELSE sha256(array_to_string(list(digest ORDER BY idx), '')) END AS digest FROM {level} GROUP BY {group}, n, idx // 16)")
        level = f"(SELECT {group}, up AS idx, (n + 15) // 16 AS n, digest FROM {name}_run{k} WHERE n > 16)"
    out.append(f"{name}_top AS MATERIALIZED ({' UNION ALL '.join(f'SELECT {group}, digest FROM {name}_run{k} WHERE n <= 16' for k in range(_LEVELS))})")
    return out


def _climb(name: str, group: str, start: str) -> list[str]:
    """CTEs that take rows (group, idx, f, proof, others) of `start` up the tree: f folded, proof with the siblings so far."""
    out, at = [], start
    same = " AND ".join(f"r.{g.strip()} = s.{g.strip()}" for g in group.split(","))
    for k in range(_LEVELS):
        place = f"s.idx // {16**k} % 16 + 1"
        left, right = f"array_to_string(r.kids[1:{place} - 1], '')", f"array_to_string(r.kids[{place} + 1:], '')"
        more = "r.n IS NOT NULL AND r.n > 1"
        out.append(f"{name}_up{k} AS MATERIALIZED (SELECT s.* REPLACE (CASE WHEN {more} THEN sha256({left} || s.f || {right}) ELSE s.f END AS f, CASE WHEN {more} THEN s.proof || {left} || {right} ELSE s.proof END AS proof) FROM {at} s LEFT JOIN {name}_run{k} r ON {same} AND r.up = s.idx // {16 ** (k + 1)})")
        at = f"{name}_up{k}"
    return out


def _manifest() -> str:
    framed = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(framed(text if c == "text" else c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"
    digits = "list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c))"
    return f"""
        WITH crc AS (SELECT {_CRC_TABLE} AS t),
        leaves AS MATERIALIZED (SELECT doc_id, source IS NOT NULL AS known, coalesce(source, '') AS src, {leaf('text')} AS digest, {leaf(_LOWER)} AS lowered, {_crc(digits, 'crc.t')} % 5 = 0 AS tampered FROM documents, crc),
        placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY known, src ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx, count(*) OVER (PARTITION BY known, src) AS n FROM leaves),
        {', '.join(_tree('low', 'known, src', 'placed', ''))},
        sources AS MATERIALIZED (SELECT 0 AS everything, known, src, digest, row_number() OVER (ORDER BY known, src) - 1 AS idx, count(*) OVER () AS n FROM low_top),
        {', '.join(_tree('high', 'everything', 'sources', ''))},
        start AS (SELECT doc_id, known, src, idx, digest, CASE WHEN tampered THEN lowered ELSE digest END AS f, '' AS proof FROM placed),
        {', '.join(_climb('low', 'known, src', 'start'))},
        middle AS (SELECT u.* EXCLUDE (idx), s.everything, s.idx, s.digest AS subroot FROM low_up{_LEVELS - 1} u JOIN sources s ON u.known = s.known AND u.src = s.src),
        {', '.join(_climb('high', 'everything', 'middle'))}
        SELECT doc_id, u.digest AS leaf, subroot, t.digest AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = t.digest AS verified FROM high_up{_LEVELS - 1} u, high_top t"""


def _spelling() -> str:
    utf8 = "flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END))"
    return f"""
        WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS t),
        runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
        counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run),
        hashed AS (SELECT run, n, {_crc(utf8, 'crc.t')} AS h FROM counted, crc),
        noisy AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
        words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM noisy WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
        longer AS (SELECT DISTINCT c.word AS a, w.word AS b FROM cut c JOIN words w ON c.less = w.word),
        near AS MATERIALIZED (SELECT a, b FROM longer UNION SELECT b, a FROM longer UNION SELECT c.word, d.word FROM cut c JOIN cut d ON c.less = d.less AND c.i = d.i AND c.word <> d.word),
        best AS (SELECT a AS word, count(*) AS n_near, min_by(w.word, (-w.n, w.word)) AS form, max(w.n) AS form_n FROM near JOIN words w ON near.b = w.word GROUP BY a),
        judged AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
        way AS (SELECT word, word AS at FROM judged UNION ALL SELECT way.word, j.form FROM way JOIN judged j ON way.at = j.word WHERE j.form IS NOT NULL)
        SELECT j.word, j.form, way.at AS root, j.n, j.n_near, j.form_n FROM judged j JOIN way ON way.word = j.word JOIN judged last ON way.at = last.word AND last.form IS NULL"""


def oracle_sql() -> dict[str, str]:
    return {"op11_merkle_manifest": _manifest(), "op13_spelling_variants": _spelling()}
