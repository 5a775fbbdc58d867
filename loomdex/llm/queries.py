"""The operators applied to their whole tables, one query each, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BPE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bpe_model_path(name: str = BPE_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomdex.llm import bpe

    coded = bpe.encode_decode(_table(spark, sf_dir, "documents"), bpe_model_path())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomdex.llm import mixing

    taken = mixing.copies(_table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomdex.llm import sharding

    placed = sharding.assign(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document with a repeated passage; documents without any have no row."""
    from loomdex.llm import substring_dedup

    found = substring_dedup.repeats(_table(spark, sf_dir, "documents"))
    largest = F.lit((1 << 63) - 1)
    return found.select(F.nullif(F.col("k"), largest).alias("doc_id"), "n_shared_words", "n_removed_words", "spans", "clusters")


def op6_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomdex.llm import ann

    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def crc_remainder(n: int) -> F.Column:
    """crc32 of doc_id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomdex.llm import langid

    docs = _table(spark, sf_dir, "documents")
    filters = langid.learn(docs.where(crc_remainder(3) != 1))
    return langid.predict(docs, filters).select("doc_id", (crc_remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op7_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomdex.llm import ngram_join

    joined = ngram_join.components(_table(spark, sf_dir, "documents"), n=3, num=90, den=100)
    return joined.select("doc_id", F.col("size").alias("n_shingles"), "component_id")


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomdex.llm import line_dedup

    cleaned = line_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", F.col("__lines").alias("n_lines"), F.size("__removed").alias("n_removed"), F.col("__removed").alias("removed"), "text")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomdex.llm import quality

    judged = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept")


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomdex.llm import lm

    docs = _table(spark, sf_dir, "documents")
    model, counts = lm.fit(docs.where(crc_remainder(7) != 2))
    scored = lm.score(docs, model, counts)
    return scored.select("doc_id", (crc_remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomdex.llm import alignment

    a, b = bpe_model_path(BPE_FILE), bpe_model_path(PIECE_FILE)
    aligned = alignment.align(_table(spark, sf_dir, "documents"), a, b)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    scored = alignment.score(aligned.withColumn("groups_sha256", digest).drop("groups"), alignment.vocabulary_size(b))
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomdex.llm import infill

    made = infill.transform(_table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(infill.restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomdex.llm import near_dedup

    placed = near_dedup.components(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_mix": op2_mix,
    "op3_shard": op3_shard,
    "op4_langid": op4_langid,
    "op5_passages": op5_passages,
    "op6_search": op6_search,
    "op7_join": op7_join,
    "op8_lines": op8_lines,
    "op9_quality": op9_quality,
    "op10_lm": op10_lm,
    "op11_align": op11_align,
    "op12_fim": op12_fim,
    "op13_near": op13_near,
}
ORACLE_SQL: dict[str, str] = {
    "op6_search": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM p WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20""",
    "op7_join": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS sh FROM w, LATERAL (SELECT unnest(generate_series(1, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, len(w) - 2) END)) AS i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON m.a = d.doc_id""",
}
