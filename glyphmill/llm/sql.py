"""DuckDB SQL for the operators that SQL can express."""

_LEVELS = 10


def repeated_passages(min_words: int = 50) -> str:
    """Brute force over all windows of min_words words, doubled by joining each with the one that follows it."""
    parts = [
        f"""WITH docs AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r\\x0b\\x0c]+'), lambda v: v <> '') AS x FROM documents WHERE text IS NOT NULL),
places AS (SELECT doc_id, x, unnest(range(len(x) - {min_words - 1})) AS p FROM docs WHERE len(x) >= {min_words}),
w0 AS (SELECT doc_id, p, md5(array_to_string(x[p + 1:p + {min_words}], ' ')) AS h FROM places)"""
    ]
    for k in range(_LEVELS):
        length = min_words << k
        parts.append(f"l{k} AS MATERIALIZED (SELECT doc_id, p, h FROM w{k} QUALIFY count(*) OVER (PARTITION BY h) > 1)")
        if k + 1 < _LEVELS:
            parts.append(f"w{k + 1} AS (SELECT a.doc_id, a.p, md5(a.h || b.h) AS h FROM l{k} a JOIN l{k} b ON a.doc_id = b.doc_id AND b.p = a.p + {length})")
    parts.append("every AS (" + " UNION ALL ".join(f"SELECT doc_id, p, {min_words << k} AS n FROM l{k}" for k in range(_LEVELS)) + ")")
    parts.append(f"marked AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {min_words} THEN 0 ELSE 1 END AS fresh FROM l0)")
    parts.append("islands AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM marked)")
    parts.append(f"spans AS (SELECT doc_id, min(p) AS s, max(p) + {min_words} AS e FROM islands GROUP BY doc_id, island)")
    return ",\n".join(parts) + "\nSELECT s.doc_id, s.s::INTEGER AS start_word, s.e::INTEGER AS end_word, max(v.n)::INTEGER AS level FROM spans s JOIN every v ON s.doc_id = v.doc_id AND v.p >= s.s AND v.p < s.e GROUP BY ALL"


def near_groups(threshold: float) -> str:
    """All pairs by their cosines, and all that is reached over them."""
    return f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {threshold}),
reached AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, l.y FROM reached r JOIN links l ON r.other = l.x)
SELECT vec_id, min(other) AS class_id, (SELECT count(*) FROM links WHERE x = vec_id) AS n_links FROM reached GROUP BY vec_id"""


def nearest(k: int, every: int) -> str:
    """Pairs of each query and all rows by their distances."""
    return f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
pairs AS (SELECT a.vec_id, b.vec_id AS neighbor_id, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {every} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbor_id) AS rank FROM pairs)
SELECT vec_id, rank::INTEGER AS rank, neighbor_id, round(d, 6) AS distance FROM ranked WHERE rank <= {k}"""


def secrets(window: int, thresholds: dict[str, float], allowed: tuple[str, ...], unit: int) -> str:
    """Entropy of every window by counting its characters anew."""
    run = f"[A-Za-z0-9+/=_-]{{{window},}}"
    allow = "|".join(f"(?:{p})" for p in allowed)
    limits = " ".join(f"WHEN '{k}' THEN {v}" for k, v in thresholds.items())
    return f"""WITH found AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '{run}') AS runs, string_split_regex(text, '{run}') AS between FROM documents WHERE regexp_matches(text, '{run}')),
candidates AS (SELECT r, doc_id, i, runs[i] AS run, list_sum(list_transform(between[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(runs[1:i - 1], lambda v: length(v))), 0) AS s
  FROM (SELECT *, unnest(range(1, len(runs) + 1)) AS i FROM found)),
kinds AS (SELECT *, CASE WHEN NOT regexp_matches(run, '[0-9]') THEN 'alpha' WHEN regexp_full_match(run, '[0-9a-fA-F]+') THEN 'hex' WHEN regexp_full_match(run, '[A-Za-z0-9]+') THEN 'alnum' ELSE 'base64' END AS kind
  FROM candidates WHERE regexp_matches(run, '[A-Za-z]') AND NOT regexp_full_match(run, '{allow}')),
windows AS (SELECT *, unnest(range(0, length(run) - {window - 1})) AS p FROM kinds),
chars AS (SELECT r, i, p, c, count(*) AS n FROM (SELECT r, i, p, unnest(string_split(substring(run, p + 1, {window}), '')) AS c FROM windows) GROUP BY ALL),
sums AS (SELECT r, i, p, sum(round_even(n * log2(n) * {unit}, 0)) AS total FROM chars GROUP BY ALL),
best AS (SELECT r, i, min(total) AS total, arg_min(p, (total, p)) AS p FROM sums GROUP BY ALL)
SELECT k.doc_id, k.s::INTEGER AS start_char, (k.s + length(k.run))::INTEGER AS end_char, k.kind, (k.s + b.p)::INTEGER AS window_char, floor((log2({window}) - b.total / {unit} / {window}) * 1000)::INTEGER AS entropy_mbits
FROM kinds k JOIN best b USING (r, i) WHERE b.total <= floor((log2({window}) - CASE k.kind {limits} END) * {window} * {unit})"""
