"""DuckDB SQL of the operators that it can express: the contracts written out plainly."""

_FINITE = "list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"


def _clustering(k=40, rounds=5, dims=64, scale=256, seed=2) -> str:
    def nearest(no):
        gap = "list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c.x) + list_inner_product(c.x, c.x)"
        return f"a{no} AS (SELECT v.no, any_value(v.vec_id) AS vec_id, any_value(v.x) AS x, min({{'d': {gap}, 'k': c.k}}) AS b FROM v, c{no} c GROUP BY v.no)"

    parts = [f"""WITH v AS (SELECT row_number() OVER () AS no, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS x
             FROM embeddings WHERE len(embedding) = {dims} AND {_FINITE})""",
             f"""c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS k, x FROM v QUALIFY k < {k})"""]
    for r in range(rounds):
        parts += [nearest(r),
                  f"""m{r} AS (SELECT k, list(s ORDER BY i) AS x FROM (SELECT b.k AS k, i, floor(sum(x[i]) / count(*)) AS s
                      FROM a{r}, range(1, {dims + 1}) t(i) GROUP BY ALL) GROUP BY k)""",
                  f"c{r + 1} AS (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (k))"]
    parts.append(nearest(rounds))
    return ",\n".join(parts) + f"""
SELECT a.vec_id, a.b.k::INTEGER AS cluster, a.b.d::BIGINT AS distance, (sum(a.b.d) OVER (PARTITION BY a.b.k))::BIGINT AS cluster_inertia,
       (sum(a.b.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(c.x, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.k = a.b.k"""


def _search(k=20, every=20, scale=64) -> str:
    return f"""WITH f AS (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND coalesce({_FINITE}, true)),
    v AS (SELECT DISTINCT vec_id, list_resize(list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)), (SELECT max(len(embedding)) FROM f), 0.0) AS x FROM f),
    s AS (SELECT q.vec_id AS query_id, q.x, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id IS DISTINCT FROM c.vec_id WHERE q.vec_id % {every} = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id, x ORDER BY score DESC, vec_id NULLS LAST))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= {k}"""


def _resampling(percent=10, least_words=20, buckets=10000, seed=2024) -> str:
    words = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
    # the usual reflected polynomial of crc32, 0xEDB88320
    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    return f"""WITH d AS (SELECT row_number() OVER () AS no, doc_id, text, {words} AS w FROM documents),
    t AS (SELECT unnest({words}) AS f FROM benchmark),
    e AS (SELECT no, unnest(w) AS f FROM d),
    crc AS (SELECT list(list_reduce([i] || range(8), lambda c, _: {step}) ORDER BY i) AS c FROM range(256) r(i)),
    x AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM e UNION SELECT f FROM t)),
    b AS (SELECT f, xor(list_reduce([4294967295] || list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
                 lambda a, y: xor(a // 256, crc.c[xor(a, y) % 256 + 1])), 4294967295) % {buckets} AS b FROM x, crc),
    s AS (SELECT b, count(*) AS s FROM e JOIN b USING (f) GROUP BY b),
    u AS (SELECT b, count(*) AS t FROM t JOIN b USING (f) GROUP BY b),
    g AS (SELECT n.b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM e) + {buckets}) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM t) + {buckets}))))::BIGINT AS gain
          FROM range({buckets}) n(b) LEFT JOIN s USING (b) LEFT JOIN u USING (b)),
    w AS (SELECT no, floor(sum(gain) / count(*))::BIGINT AS weight FROM e JOIN b USING (f) JOIN g USING (b) GROUP BY no),
    r AS (SELECT d.no, doc_id, text, len(d.w) AS n, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
          FROM d LEFT JOIN w USING (no)),
    k AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM r)
SELECT doc_id, n::BIGINT AS n_features, weight, score,
       CASE WHEN n >= {least_words} AND row_number() OVER o <= {percent} * (count(*) FILTER (n >= {least_words}) OVER ()) // 100 THEN row_number() OVER o END::BIGINT AS rank
FROM k WINDOW o AS (ORDER BY n < {least_words}, score DESC, doc_id NULLS LAST, text)"""


ORACLES = {"op11_centroid_clustering": _clustering(), "op12_exact_topk": _search(), "op13_importance_resampling": _resampling()}
