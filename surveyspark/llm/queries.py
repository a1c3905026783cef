"""Registered queries of this package, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_SHARD_LIMIT = 1 << 20


@query("op1_extendible_sharding", f"""
    WITH i AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes,
               ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
    d AS (SELECT i.*, t.d::INT AS depth, h >> (60 - t.d)::INT AS prefix FROM i, range(0, 61) t(d)),
    s AS (SELECT depth, prefix, sum(n_bytes) AS b, count(*) AS n FROM d GROUP BY depth, prefix)
    SELECT doc_id, any_value(n_bytes) AS n_bytes, min(depth) AS depth, arg_min(prefix, depth) AS prefix, 0::BIGINT AS page
    FROM d JOIN s USING (depth, prefix) WHERE s.b <= {_SHARD_LIMIT} OR s.n = 1 GROUP BY doc_id
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of at most 1 MiB of text by extendible hashing of document ids."""
    from pyspark.sql import functions as F

    from surveyspark.llm.sharding import extendible_shards

    return extendible_shards(table(spark, sf_dir, "documents"), "doc_id", F.octet_length("text"), _SHARD_LIMIT)


@query("op2_toxicity_nbsvm")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; ids with crc32 mod 3 = 1 are held out of the fit."""
    from pyspark.sql import functions as F

    from surveyspark.llm.toxicity import fit_toxicity, held_out

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.filter(~held_out("doc_id")))
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), model.score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query("op3_adaptive_dimension_ann")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest embeddings of every hundredth one."""
    from surveyspark.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", k=10)


@query("op4_multi_length_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in training sequences of at most 2048 tokens."""
    import public_tokenizers

    from surveyspark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op5_exact_inner_products", """
    WITH x AS (SELECT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
    p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
          FROM x q JOIN x c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five largest integer inner products of every fiftieth embedding."""
    from surveyspark.llm.topk import largest_products

    return largest_products(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5)


@query("op6_pfair_mixing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in the mixture of its sources."""
    from surveyspark.llm.mixing import mix_order

    return mix_order(table(spark, sf_dir, "documents"))


@query("op7_suffix_array_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in 400-byte strings that occur more than once, cut from every document."""
    from surveyspark.llm.lpf_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


@query("op8_suffix_automaton_dedup", r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win
          FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
    f AS (SELECT win, min(doc_id) AS first FROM s GROUP BY win),
    g AS (SELECT DISTINCT s.doc_id, i + o AS p FROM s JOIN f USING (win), range(0, 13) t(o) WHERE f.first < s.doc_id),
    p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
    k AS (SELECT p.doc_id, count(g.p) AS n_removed, string_agg(CASE WHEN g.p IS NULL THEN word END, ' ' ORDER BY p.p) AS kept
          FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.p = p.p GROUP BY p.doc_id)
    SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
    FROM w LEFT JOIN k ON k.doc_id = w.doc_id
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in 13-word windows that also start in a smaller document, cut from every document."""
    from surveyspark.llm.automaton_dedup import remove_seen

    return remove_seen(table(spark, sf_dir, "documents"))


@query("op9_pii_bilstm_crf")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: spans of the rules and of the trained tagger."""
    from surveyspark.llm.pii import find_personal_data, fit_tagger

    docs = table(spark, sf_dir, "documents")
    return find_personal_data(docs, fit_tagger(docs))


@query("op10_lsh_forest_dedup", r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS x FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach),
    c AS (SELECT node, min(reach) AS component FROM r GROUP BY node)
    SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component, w.doc_id) AS component_id,
           w.doc_id = coalesce(c.component, w.doc_id) AS kept
    FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.node = w.doc_id
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components over 2-word shingles."""
    from surveyspark.llm.forest_dedup import near_components

    return near_components(table(spark, sf_dir, "documents"), words=2)


@query("op11_frequency_trie_spelling", r"""
    WITH RECURSIVE g AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) AS t),
    r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
    c AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 5 GROUP BY doc_id, run),
    x AS (SELECT doc_id, run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS b FROM c),
    y AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(b), 2), lambda i: ('0x' || substr(b, i, 2))::BIGINT)),
                 lambda h, v: xor(h >> 8, g.t[(xor(h, v) & 255) + 1])), 4294967295) AS h FROM x, g),
    z AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM y),
    w AS (SELECT word, sum(n)::BIGINT AS n, length(word) AS len FROM z WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
    v AS (SELECT word, n, i, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS holed FROM (SELECT word, n, unnest(range(1, len + 1)) AS i FROM w)),
    s AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM v),
    p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM v a JOIN v b ON a.holed = b.holed AND a.word <> b.word
          UNION SELECT s.word, w.word, w.n FROM s JOIN w ON w.word = s.cut UNION SELECT w.word, s.word, s.n FROM s JOIN w ON w.word = s.cut),
    q AS (SELECT word, count(*) AS n_near, max(near_n) AS top, arg_min(near, (-near_n, encode(near))) AS best FROM p GROUP BY word),
    f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 2 * w.n THEN best END AS form, CASE WHEN top >= 2 * w.n THEN top END::BIGINT AS form_n
          FROM w LEFT JOIN q USING (word)),
    u AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT u.word, f.word, f.form FROM u JOIN f ON f.word = u.next)
    SELECT f.word, form, root, n, n_near, form_n FROM f JOIN u ON u.word = f.word WHERE u.next IS NULL
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, the form each is a variant of, and its root."""
    from surveyspark.llm.spelling import spelling_forms

    return spelling_forms(table(spark, sf_dir, "documents"))


@query("op12_prefix_filter_decontamination", r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
    i AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[s:s + least(10, len(ws)) - 1], ' ') AS win
          FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS s FROM b WHERE len(ws) > 0)),
    o AS (SELECT doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') AS win FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM i) WHERE len(ws) >= n)),
    h AS (SELECT doc_id, item_id, s, o.n FROM o JOIN i ON o.win = i.win AND o.n = i.n),
    k AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
    t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
    SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in ten-word windows of benchmark items."""
    from surveyspark.llm.decontamination import digest, find_leaks

    return digest(find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op13_secondary_sort_negatives", """
    WITH x AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS v FROM embeddings
               WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
    p AS (SELECT q.vec_id AS anchor_id, c.vec_id AS id, q.label = c.label AS same, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
          FROM x q JOIN x c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
    g AS (SELECT anchor_id, id, score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
    n AS (SELECT g.anchor_id, g.id AS positive_id, g.score AS positive_score, p.id AS negative_id, p.score AS negative_score,
                 row_number() OVER (PARTITION BY g.anchor_id, g.id ORDER BY p.score DESC, p.id)::INT AS rank
          FROM g JOIN p ON p.anchor_id = g.anchor_id AND NOT p.same AND 80 * g.score <= 100 * p.score AND 100 * p.score <= 100 * g.score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding, with some labels moved on by one."""
    from pyspark.sql import functions as F

    from surveyspark.llm.negatives import mine_negatives

    x = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(x.withColumn("label", moved))
