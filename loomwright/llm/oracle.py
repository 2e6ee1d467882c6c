"""DuckDB SQL of the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import licences


def _escaped(x: str) -> str:
    """The length of an escaped text; what is put in doesn't matter for it."""
    return rf"length(regexp_replace(regexp_replace(regexp_replace(replace({x}, '\', '\\'), '(<)(\||/?s>|</?SYS>>)', '\1_\2', 'g'), '(\[)(/?INST\])', '\1_\2', 'g'), '(\|)(>)', '\1_\2', 'g'))"


def _lower(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _canonical_lines(x: str) -> str:
    x = rf"regexp_replace(lower(coalesce({x}, '')), '{licences.COPYRIGHT_LINE}', '', 'g')"
    x = rf"regexp_replace({x}, '{licences.BETWEEN}', ' ', 'g')"
    for old, new in licences.SPELLINGS.items():
        x = f"replace({x}, '{old}', '{new}')"
    return x


def _known() -> str:
    entries = [entry.split("\n", 1) for entry in licences.KNOWN.strip().split("\n\n")]
    return ", ".join("('{}', '{}')".format(*(part.replace("'", "''") for part in entry)) for entry in entries)


def _crc32(x: str) -> str:
    """The checksum of an ASCII text, a bit at a time."""
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"list_reduce(list_prepend(xor(a, b), range(8)), lambda c, k: {bit})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}, ''), lambda s: ascii(s)::BIGINT)), lambda a, b: {byte}), 4294967295)"


def _rounds(rounds: int) -> str:
    """CTEs c0 (cluster, i, v), then for each round a (vec, cluster, d) and the next centroids; the last a is the result's."""
    out = []
    for r in range(rounds + 1):
        out.append(f"""
        d{r} AS (SELECT vec, cluster, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d FROM x JOIN c{r} c USING (i) GROUP BY vec, cluster),
        a{r} AS (SELECT vec, min_by(cluster, (d, cluster)) AS cluster, min(d) AS d FROM d{r} GROUP BY vec)""")
        if r < rounds:
            out.append(f"""
        m{r} AS (SELECT cluster, i, sum(v)::HUGEINT AS s, count(*) AS n FROM x JOIN a{r} USING (vec) GROUP BY cluster, i),
        c{r + 1} AS (SELECT c.cluster, c.i, coalesce((CASE WHEN s < 0 THEN -((-s + n - 1) // n) ELSE s // n END)::BIGINT, c.v) AS v FROM c{r} c LEFT JOIN m{r} USING (cluster, i))""")
    return ",".join(out)


#: From links (a, b): the smallest node that each linked node reaches.
_COMPONENTS = """
    both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
    least_id AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a)
"""

ORACLE_SQL: dict[str, str] = {
    "op2_chat_prefix_targets": rf"""
        WITH r AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        s AS (SELECT *, role = 'assistant' AS target, 10 + {_escaped("role")} + {_escaped("text")} AS size FROM r),
        w AS (
            SELECT *, sum(size) OVER o AS upto, row_number() OVER o AS i, count(*) OVER (PARTITION BY conv_id) AS n
            FROM s WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
            sum(CASE WHEN target THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE target), '')) AS loss_sha256,
            sum(CASE WHEN target OR i = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars
        FROM w GROUP BY conv_id
    """,
    "op4_minhash_near_dedup": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_lower("text")}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
        sets AS (
            SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 3], ' ') END AS s
            FROM w, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS t(i) WHERE len(ws) > 0),
        sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
        {_COMPONENTS}
        SELECT doc_id, coalesce(n, 0) AS n_shingles, least(coalesce(component, doc_id), doc_id) AS component_id, doc_id = least(coalesce(component, doc_id), doc_id) AS kept
        FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least_id ON id = doc_id
    """,
    "op5_winnowing_decontamination": rf"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_lower("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
        i AS (SELECT item_id, regexp_extract_all({_lower("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id::VARCHAR AS item, least(13, len(ws)) AS n, array_to_string(ws[j:j + least(13, len(ws)) - 1], ' ') AS g
            FROM i, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS t(j) WHERE len(ws) > 0),
        grams AS (
            SELECT doc_id, n, j, array_to_string(ws[j:j + n - 1], ' ') AS g
            FROM d, (SELECT DISTINCT n FROM windows), unnest(range(1, len(ws) - n + 2)) AS t(j)),
        met AS (SELECT doc_id, item, n, j FROM grams JOIN windows USING (n, g)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM met, unnest(range(j, j + n)) AS t(p) GROUP BY doc_id),
        names AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM met GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN names USING (doc_id)
    """,
    "op8_licence_scan": rf"""
        WITH known AS (SELECT min(licence) AS licence, sha256(c) AS digest FROM (
            SELECT licence, trim(regexp_replace({_canonical_lines("said")}, '[ \n]+', ' ', 'g')) AS c FROM (VALUES {_known()}) AS k(licence, said)) GROUP BY c),
        d AS (SELECT doc_id, {_canonical_lines("text")} AS c FROM documents),
        lines AS (SELECT doc_id, licence FROM (SELECT doc_id, unnest(string_split(c, chr(10))) AS line FROM d) JOIN known ON sha256(trim(line)) = digest),
        notices AS (SELECT doc_id, count(*) AS n_notices, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices FROM lines GROUP BY doc_id),
        whole AS (SELECT doc_id, sha256(trim(regexp_replace(c, '[ \n]+', ' ', 'g'))) AS digest FROM d)
        SELECT doc_id, digest, licence, coalesce(n_notices, 0) AS n_notices, coalesce(notices, '') AS notices
        FROM whole LEFT JOIN known USING (digest) LEFT JOIN notices USING (doc_id)
    """,
    "op11_line_dedup": f"""
        WITH l AS (
            SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
        k AS (SELECT *, {_lower("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
        shared AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
        f AS (SELECT doc_id, line, i, key IN (SELECT key FROM shared) AS gone FROM k),
        g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, gone ORDER BY i) AS island FROM f),
        runs AS (SELECT doc_id, island, min(i) - 1 AS s, max(i) AS e FROM g WHERE gone GROUP BY doc_id, island),
        maps AS (
            SELECT doc_id, string_agg((s - p)::VARCHAR || ',' || (e - s)::VARCHAR, ',' ORDER BY s) AS keep
            FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS p FROM runs) GROUP BY doc_id)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256, any_value(keep) AS keep
        FROM f LEFT JOIN maps USING (doc_id) GROUP BY doc_id
    """,
    "op12_centroid_clustering": f"""
        WITH kept AS (
            SELECT row_number() OVER () AS vec, vec_id, list_transform(embedding, lambda v: floor(64 * v::DOUBLE)::BIGINT) AS xs
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64),
        x AS (SELECT vec, unnest(range(64)) AS i, unnest(xs) AS v FROM kept),
        first AS (SELECT vec, row_number() OVER (ORDER BY sha256('1:' || vec_id), xs) - 1 AS cluster FROM kept QUALIFY cluster < 16),
        c0 AS (SELECT cluster, i, v FROM x JOIN first USING (vec)),
        {_rounds(3)},
        said AS (SELECT cluster, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY cluster)
        SELECT vec_id, cluster::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
        FROM a3 JOIN kept USING (vec) JOIN said USING (cluster)
    """,
    "op13_periodic_runs": rf"""
        WITH h AS (SELECT doc_id, {_crc32("doc_id::VARCHAR")} AS h, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
        p AS (SELECT *, h // 10 AS g, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM h),
        d AS (SELECT doc_id, n, ws, a, 1 + (n - a) // (3 + g % 8) AS p FROM p),
        w AS (
            SELECT doc_id, n, i, ws[1 + CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % p END] AS w
            FROM (SELECT *, unnest(range(n)) AS i FROM d)),
        e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
        s AS (
            SELECT doc_id, q, min(i) AS start, count(*) + q AS length
            FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e) GROUP BY doc_id, q, island),
        r AS (SELECT doc_id, start, length, min(q) AS period FROM s WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
        b AS (
            SELECT doc_id, count(*) AS n_runs, max_by({{'s': start, 'l': length, 'p': period}}, (length, -start, -period)) AS best,
                string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said
            FROM r GROUP BY doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
        c AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, 1000 * best.l // best.p AS exponent_milli,
            sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM documents LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)
    """,
}
