"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import exact_dedup, html_text, line_dedup, minhash, mixing, odd_sketch, packing, quality, sharding, simhash, substring_dedup, variants, vector_codes
from scriptorium.llm.common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprint_documents(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_positions(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).drop("label")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(table(spark, sf_dir, "documents"))


def op13_minhash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.near_components(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_sharding, op2_simhash, op3_html_text, op4_packing, op5_substring_dedup, op6_exact_dedup, op7_fingerprints, op8_mixing, op9_line_dedup, op10_quality,
        op11_vector_codes, op12_spelling_variants, op13_minhash_near,
    ]
    return {f.__name__: f for f in found}


SQL = {
    "op6_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm)
""",
    "op12_spelling_variants": r"""
WITH RECURSIVE crc_table AS (SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
counted AS (SELECT id, run, count(*) AS k FROM runs GROUP BY id, run),
bytes AS (SELECT run, k, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS b FROM counted),
hashed AS (SELECT run, k, xor(list_reduce([4294967295::BIGINT] || b::BIGINT[], lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc_table),
v AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n
    FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cut AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS r FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.r = b.r AND a.word <> b.word
    UNION SELECT cut.word, v.word FROM cut JOIN v ON cut.r = v.word
    UNION SELECT v.word, cut.word FROM cut JOIN v ON cut.r = v.word),
best AS (SELECT near.word, count(*) AS n_near, first(near.other ORDER BY o.n DESC, near.other) AS other, max(o.n) AS other_n FROM near JOIN v o ON o.word = near.other GROUP BY near.word),
forms AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * v.n THEN other END AS form, CASE WHEN other_n >= 5 * v.n THEN other_n END AS form_n
    FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM forms UNION SELECT chain.word, forms.form FROM chain JOIN forms ON forms.word = chain.root WHERE forms.form IS NOT NULL),
ends AS (SELECT chain.word, chain.root FROM chain JOIN forms ON forms.word = chain.root WHERE forms.form IS NULL)
SELECT word, n, n_near, form, form_n, root FROM forms JOIN ends USING (word)
""",
    "op13_minhash_near": r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT rid, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS g FROM w),
size AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
common AS (SELECT a.rid AS u, b.rid AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY a.rid, b.rid),
link AS (SELECT u, v FROM common JOIN size x ON x.rid = u JOIN size y ON y.rid = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
ways AS MATERIALIZED (SELECT u, v FROM link UNION SELECT v, u FROM link),
reach AS (SELECT rid, rid AS other FROM w UNION SELECT reach.rid, ways.v FROM reach JOIN ways ON ways.u = reach.other),
least AS (SELECT reach.rid, min(w.doc_id) AS component_id FROM reach JOIN w ON w.rid = reach.other GROUP BY reach.rid)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM w JOIN least USING (rid) LEFT JOIN size USING (rid)
""",
}


def _vector_codes_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """The rounds of op11 written one after another, each over all distances."""
    sql = """
WITH k AS (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * 1024) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS MATERIALIZED (SELECT rid, p, v[len(v) * p // 4 + 1 : len(v) * (p + 1) // 4] AS x FROM k, range(4) t(p)),
s AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS e, v FROM (SELECT vec_id, min(v) AS v FROM k GROUP BY vec_id ORDER BY vec_id LIMIT 256)),
b0 AS MATERIALIZED (SELECT p, e, v[len(v) * p // 4 + 1 : len(v) * (p + 1) // 4] AS c FROM s, range(4) t(p))"""
    for i in range(rounds + 1):
        sql += f""",
a{i} AS MATERIALIZED (SELECT rid, q.p, min(struct_pack(d := list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := e)) AS f
    FROM q JOIN b{i} b ON b.p = q.p GROUP BY rid, q.p)"""
        if i < rounds:
            sql += f""",
m{i} AS (SELECT p, e, list(avg ORDER BY j) AS c FROM (SELECT q.p, f.e AS e, j, (sum(x[j]) - ((sum(x[j]) % count(*)) + count(*)) % count(*)) // count(*) AS avg
    FROM a{i} a JOIN q ON a.rid = q.rid AND a.p = q.p, range(1, 65536) t(j) WHERE j <= len(x) GROUP BY q.p, f.e, j) GROUP BY p, e),
b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c::BIGINT[], b.c) AS c FROM b{i} b LEFT JOIN m{i} m ON m.p = b.p AND m.e = b.e)"""
    return f"""{sql},
o AS (SELECT rid, string_agg(printf('%02x', f.e), '' ORDER BY p) AS code, sum(f.d)::BIGINT AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM o JOIN k USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return SQL | {"op11_vector_codes": _vector_codes_sql()}
