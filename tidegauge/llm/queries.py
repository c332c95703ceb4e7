"""The registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.llm.common import split_of, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


CRC_TABLE = """
    crc_rounds AS (
        SELECT b, list_reduce(list_prepend(CAST(b AS BIGINT), [CAST(x AS BIGINT) FOR x IN range(8)]),
                              lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
        FROM range(256) t(b)),
    crc_table AS (SELECT list(v ORDER BY b) AS t FROM crc_rounds)"""


@query("op9_byte_shards", f"""
    WITH {CRC_TABLE},
    sized AS (
        SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size,
               xor(4294967295, list_reduce(
                   list_prepend(4294967295, [CAST('0x' || hex(encode(coalesce(text, '')))[2 * i - 1:2 * i] AS BIGINT)
                                             FOR i IN range(1, strlen(coalesce(text, '')) + 1)]),
                   lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]))) AS text_crc32
        FROM documents, crc_table),
    placed AS (
        SELECT *, sum(size) OVER w - size AS start, sum(size) OVER () AS total
        FROM sized WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)),
    cut AS (SELECT *, least(39, ((2 * start + size) * 40) // (2 * total)) AS shard FROM placed)
    SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
           row_number() OVER (PARTITION BY shard ORDER BY start, doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
    FROM cut""")
def op9_byte_shards(spark: SparkSession, folder: str) -> DataFrame:
    from tidegauge.llm.sharding import byte_shards

    return byte_shards(table(spark, folder, "documents"), shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op10_mixing", r"""
    WITH sized AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
               CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
        FROM documents),
    sources AS (SELECT source, sum(size) AS source_size FROM sized GROUP BY source),
    ranked AS (
        SELECT source, source_size, 2 * source_size AS cap, 1.5 * CAST(sum(source_size) OVER () AS DOUBLE) AS budget,
               [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM sources),
    levels AS (
        SELECT *, (budget - coalesce(sum(cap) OVER before, 0)) / sum(weight) OVER after AS level
        FROM ranked WINDOW before AS (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                           after AS (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    final AS (SELECT arg_min(level, (cap / weight, source)) AS level FROM levels WHERE weight * level <= cap),
    goals AS (
        SELECT source, source_size, coalesce(least(weight * level, cap), cap) AS target,
               CASE WHEN source_size > 0 THEN CAST(floor(coalesce(least(weight * level, cap), cap) / source_size) AS BIGINT) ELSE 0 END AS epochs
        FROM ranked, final),
    placed AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM sized)
    SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
           CAST(epochs * size + greatest(0, least(size, round(target) - epochs * source_size - start)) AS BIGINT) AS taken
    FROM placed JOIN goals ON placed.source IS NOT DISTINCT FROM goals.source""")
def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from tidegauge.llm.mixing import mix

    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op7_simhash")
def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    from tidegauge.llm.simhash import near_duplicates

    return near_duplicates(table(spark, folder, "documents"), distance=2).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op2_language")
def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    from tidegauge.llm.langid import identify, train

    docs = table(spark, folder, "documents")
    held_out = split_of("doc_id", 4) == 2
    model = train(docs, ~held_out)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from tidegauge.llm.toxicity import fit, score

    docs, held_out = table(spark, folder, "documents"), split_of("doc_id", 4) == 2
    detector = fit(docs, table(spark, folder, "labels"), ~held_out)
    return score(docs.select("doc_id", "text"), detector).select(
        "doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


@query("op1_packing")
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from tidegauge.llm.packing import pack

    pieces = pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), window=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op3_media")
def op3_media(spark: SparkSession, folder: str) -> DataFrame:
    from tidegauge.llm.media import store

    return store(table(spark, folder, "documents"), keep=())


@query("op4_licenses")
def op4_licenses(spark: SparkSession, folder: str) -> DataFrame:
    from tidegauge.llm.licenses import license_scan

    base, found = F.col("base"), F.col("detections")
    names = F.array_sort(F.array_distinct(base["label"]))
    return license_scan(table(spark, folder, "documents")).select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(base["word"]).alias("first_word"),
        F.array_max(base["word"]).alias("last_word"), F.array_join(names, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(names, found["label"])), ",").alias("labels"),
        (F.coalesce(F.array_max(found["priority"]), F.lit(0)) / 100.0).cast("double").alias("score"))


@query("op6_topk", """
    WITH whole AS (
        SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id,
               CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
        FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
    SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored
    WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10""")
def op6_topk(spark: SparkSession, folder: str) -> DataFrame:
    from tidegauge.llm.topk import top_k

    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("op8_lm")
def op8_lm(spark: SparkSession, folder: str) -> DataFrame:
    from tidegauge.llm.lm import lm_scores

    held_out = split_of("doc_id", 5) == 1
    return lm_scores(table(spark, folder, "documents"), ~held_out).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op12_byte_bpe")
def op12_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from tidegauge.llm.bytebpe import decode, encode

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = encode(table(spark, folder, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN).drop("text")
    return decode(ids, path, public_tokenizers.PATTERN).select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op11_spelling", f"""
    WITH RECURSIVE {CRC_TABLE},
    runs AS (
        SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')),
                                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
        FROM documents),
    met AS (
        SELECT doc_id, run, count(*) AS n, encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS bytes
        FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
    marked AS (
        SELECT run, n, xor(4294967295, list_reduce(
                   list_prepend(4294967295, [CAST('0x' || hex(bytes)[2 * i - 1:2 * i] AS BIGINT) FOR i IN range(1, octet_length(bytes) + 1)]),
                   lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]))) AS h
        FROM met, crc_table),
    typed AS (
        SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM marked),
    words AS MATERIALIZED (
        SELECT word, CAST(sum(n) AS BIGINT) AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    gaps AS MATERIALIZED (
        SELECT word, n, i, CASE WHEN i = 0 THEN word ELSE substr(word, 1, i - 1) || substr(word, i + 1) END AS gap
        FROM (SELECT word, n, unnest(range(0, length(word) + 1)) AS i FROM words)),
    pairs AS (
        SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n
        FROM gaps a JOIN gaps b ON a.gap = b.gap AND a.word <> b.word WHERE a.i = b.i OR a.i = 0 OR b.i = 0),
    best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS form, max(near_n) AS form_n FROM pairs GROUP BY word),
    named AS MATERIALIZED (
        SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= 10 * w.n THEN b.form END AS form,
               CASE WHEN b.form_n >= 10 * w.n THEN b.form_n END AS form_n
        FROM words w LEFT JOIN best b ON w.word = b.word),
    walk AS (
        SELECT word, word AS root FROM named
        UNION ALL SELECT walk.word, named.form FROM walk JOIN named ON walk.root = named.word WHERE named.form IS NOT NULL)
    SELECT named.word, named.form, walk.root, named.n, named.n_near, named.form_n
    FROM named JOIN walk ON walk.word = named.word JOIN named last ON last.word = walk.root AND last.form IS NULL""")
def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    from tidegauge.llm.variants import spelling_variants

    return spelling_variants(table(spark, folder, "documents"))


@query("op13_prefix_trie", f"""
    WITH {CRC_TABLE},
    places AS (
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place,
               coalesce(role, '') AS role, coalesce(text, '') AS text
        FROM conversations WHERE conv_id IS NOT NULL),
    ids AS (
        SELECT conv_id, xor(4294967295, list_reduce(
                   list_prepend(4294967295, [CAST(ascii(CAST(conv_id AS VARCHAR)[i]) AS BIGINT) FOR i IN range(1, length(CAST(conv_id AS VARCHAR)) + 1)]),
                   lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]))) % 6 AS head
        FROM (SELECT DISTINCT conv_id FROM places), crc_table),
    rebuilt AS (
        SELECT conv_id, place, role, text FROM places JOIN ids USING (conv_id) WHERE place > head
        UNION ALL
        SELECT ids.conv_id, place, role, text FROM ids JOIN places ON places.conv_id = ids.conv_id - ids.conv_id % 100 AND place <= head),
    paths AS (
        SELECT conv_id, length(text) AS letters, list(md5(md5(role) || md5(text))) OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS seq
        FROM rebuilt
        UNION ALL SELECT conv_id, 0, CAST([] AS VARCHAR[]) FROM ids),
    nodes AS MATERIALIZED (
        SELECT seq, min(conv_id) AS conv_id, len(seq) AS depth, count(*) AS n_convs, max(letters) AS letters FROM paths GROUP BY seq),
    children AS (SELECT seq[1:depth - 1] AS seq, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
    below AS (
        SELECT seq[1:d] AS seq, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
        FROM (SELECT n.seq, unnest(range(0, depth + 1)) AS d, CAST(n_children IS NULL AS INTEGER) AS leaf, (n_convs - 1) * letters AS saved
              FROM nodes n LEFT JOIN children c ON n.seq = c.seq)
        GROUP BY 1),
    ends AS (
        SELECT seq, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends
        FROM (SELECT conv_id, arg_max(seq, len(seq)) AS seq FROM paths GROUP BY conv_id) GROUP BY seq)
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
           CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
    FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.seq = n.seq[1:n.depth - 1] LEFT JOIN children c ON c.seq = n.seq
         JOIN below b ON b.seq = n.seq LEFT JOIN ends e ON e.seq = n.seq""")
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    from tidegauge.llm.common import written
    from tidegauge.llm.convtrie import heads_taken_over, prefix_trie, turn_digests

    turns = written(turn_digests(table(spark, folder, "conversations")))
    return prefix_trie(turns.select("conv_id").distinct(), heads_taken_over(turns, block=100, most=6))
