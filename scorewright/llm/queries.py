"""Queries of the llm operators over the supplied tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorewright.llm.byte_bpe import decoded, encoded
from scorewright.llm.kn_quality import judged
from scorewright.llm.latent_search import leaks
from scorewright.llm.line_runs import line_runs
from scorewright.llm.metric_join import metric_join
from scorewright.llm.mixing import WORD, mix_sources
from scorewright.llm.parity_join import parity_sketch_join
from scorewright.llm.periodic_runs import periodic_runs
from scorewright.llm.prefix_trie import prefix_trie
from scorewright.llm.string_kernel import toxicity
from scorewright.llm.store import row_key, scratch, written
from scorewright.llm.substring_sa import remove_repeats
from scorewright.llm.token_rollups import Rollups, token_counts
from scorewright.llm.warc import archived


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived and read back."""
    read = archived(_table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-equal embeddings of a label at cosine 0.98."""
    return metric_join(_table(spark, sf_dir, "embeddings"))


def op4_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates by distinct 4-word shingles at 85 percent."""
    return parity_sketch_join(_table(spark, sf_dir, "documents"), n=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op5_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after batches: all documents by words, recounted by a byte-level vocabulary, copies deleted; two are sent again."""
    docs = _table(spark, sf_dir, "documents").withColumn("words", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    docs = docs.select("doc_id", "source", "lang", "words", F.xxhash64("text").alias("t1"), F.md5("text").alias("t2"), row_key("doc_id", "text").alias("rk"), "text")
    counts = written(token_counts(docs), "counts")
    by_words = [F.lit("words-1").alias("tokenizer"), F.col("words").alias("tokens")]
    by_ranks = [F.lit("byte-bpe-50k").alias("tokenizer"), F.col("_tokens").alias("tokens")]
    none = [F.lit(None).cast(t).alias(c) for c, t in (("old_source", "string"), ("old_lang", "string"), ("old_tokenizer", "string"), ("old_tokens", "long"))]
    old = lambda pair: [F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), pair[0].alias("old_tokenizer"), pair[1].alias("old_tokens")]
    loaded = counts.select(F.lit("insert").alias("op"), *none, "source", "lang", *by_words)
    recounted = counts.select(F.lit("revise").alias("op"), *old(by_words), "source", "lang", *by_ranks)
    first = counts.where("t2 is not null").groupBy("t1", "t2").agg(F.min(F.struct("doc_id", "rk")).alias("first"))
    copies = counts.join(first, ["t1", "t2"]).where(F.struct("doc_id", "rk") > F.col("first"))
    deleted = copies.select(F.lit("delete").alias("op"), *old(by_ranks), "source", "lang", *by_ranks)

    rollups = Rollups(spark, scratch(spark, "rollups"))
    for batch_id, changes in (("load", loaded), ("recount", recounted), ("copies", deleted), ("recount", recounted), ("copies", deleted)):
        rollups.apply(batch_id, changes)
    return rollups.totals()


def op6_latent_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, exact or paraphrased."""
    found = leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("common", 6).alias("common"), F.round("answer", 6).alias("answer"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix of all documents by source weights 1, 2, 3."""
    return mix_sources(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of every document."""
    found = judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), "lang", "n_symbols", F.round("perplexity", 4).alias("perplexity"), F.round("threshold", 4).alias("threshold"), "kept")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 400 bytes removed, and whether a document holds any."""
    return remove_repeats(_table(spark, sf_dir, "documents")).withColumn("repeats", F.col("n_removed") > 0)


def op10_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later copies of runs of three lines deleted."""
    cut = line_runs(_table(spark, sf_dir, "documents"), min_words=None)  # its SQL knows lines only
    return cut.select("row.doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("kept_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every text, and digests of them and of the text without their repeats."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = docs.withColumn("_h", h).withColumn("_g", F.floor(F.col("_h") / 10))
    docs = docs.withColumn("_words", F.when(F.col("_h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    n, g = F.size("_words").cast("long"), F.col("_g")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    place = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
    repeated = F.array_join(F.transform(place, lambda i: F.get("_words", i)), " ")
    found = periodic_runs(docs.select("doc_id", F.when(n > 0, repeated).otherwise(F.col("text")).alias("text")))
    longer = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    best = F.reduce("runs", F.get("runs", F.lit(0)), longer)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as ids of a byte-level vocabulary, and back."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids = encoded(_table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern).drop("text")
    back = decoded(ids, ranks, pattern)
    return back.select("doc_id", "n_tokens", F.sha2("tokens", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``(conv_id, position, role, text)``: every conversation begins with up to eight turns of the one whose id divides by
    five before it; a conversation without turns keeps one row without position."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    named = conversations.where("conv_id is not null")
    turns = named.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("position", F.row_number().over(order))
    h = F.crc32(F.col("conv_id").cast("string")) % 9
    ids = named.select("conv_id").distinct()
    own = turns.where(F.col("position") > h).select("conv_id", "position", "role", "text")
    heads = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), h.alias("h")).where("h > 0")
    base = turns.where("position <= 8").select(F.col("conv_id").alias("base"), "position", "role", "text")
    head = heads.join(base, "base").where("position <= h").select("conv_id", "position", "role", "text")
    none = ids.select("conv_id", F.lit(None).cast("int").alias("position"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    return own.unionByName(head).unionByName(none)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return prefix_trie(rebuilt(_table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_string_kernel": op2_string_kernel,
    "op3_metric_join": op3_metric_join,
    "op4_parity_join": op4_parity_join,
    "op5_token_rollups": op5_token_rollups,
    "op6_latent_search": op6_latent_search,
    "op7_mixing": op7_mixing,
    "op8_quality": op8_quality,
    "op9_substrings": op9_substrings,
    "op10_line_runs": op10_line_runs,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_prefix_trie": op13_prefix_trie,
}

_OP1 = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), g AS (
    SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p
)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
    CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM g
"""

_OP10 = r"""
WITH raw AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nr FROM documents
), lines AS (
    SELECT doc_id, line, nr, row_number() OVER (PARTITION BY doc_id ORDER BY nr) AS pos
    FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), runs AS (
    SELECT doc_id, pos, line AS a, lead(line) OVER w AS b, lead(line, 2) OVER w AS c FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), later AS (
    SELECT doc_id, pos FROM (
        SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS k FROM runs WHERE c IS NOT NULL
    ) WHERE k > 1
), dead AS (
    SELECT DISTINCT doc_id, pos + d AS pos FROM later, (SELECT unnest([0, 1, 2]) AS d)
), gone AS (
    SELECT l.doc_id, l.nr, l.pos FROM lines l JOIN dead USING (doc_id, pos)
), counted AS (
    SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE fresh) AS n_runs
    FROM (SELECT doc_id, pos, coalesce(pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 1, true) AS fresh FROM gone) GROUP BY doc_id
), kept AS (
    SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.nr) AS text
    FROM raw r LEFT JOIN gone g ON g.doc_id = r.doc_id AND g.nr = r.nr WHERE g.nr IS NULL GROUP BY r.doc_id
)
SELECT d.doc_id, (SELECT count(*) FROM lines l WHERE l.doc_id = d.doc_id) AS n_lines, coalesce(c.n_removed, 0) AS n_removed,
    coalesce(c.n_runs, 0) AS n_runs, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN counted c USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

#: Unsigned CRC-32 of a column's decimal text
_CRC32 = """xor(4294967295, list_reduce(
    list_transform(range(1, length({0}::VARCHAR) + 1), lambda k: ascii(substr({0}::VARCHAR, k, 1))::BIGINT),
    lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END), xor(c, b)), 4294967295::BIGINT))"""

_OP11 = r"""
WITH raw AS (
    SELECT doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
    FROM (SELECT *, @CRC@ AS h FROM documents)
), sized AS (
    SELECT *, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN g % len(ws) END AS a FROM raw
), cut AS (
    SELECT *, CASE WHEN a IS NOT NULL THEN 1 + (n - a) // (3 + g % 8) END AS p FROM sized
), docs AS (
    SELECT doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: ws[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS ws FROM cut
), words AS (
    SELECT doc_id, n, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM docs
), returns AS (
    SELECT x.doc_id, y.i - x.i AS q, x.i AS i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
), islands AS (
    SELECT doc_id, q, min(i) AS start, count(*) + q AS length
    FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM returns) GROUP BY doc_id, q, island
), runs AS (
    SELECT doc_id, start, length, min(q) AS period FROM islands WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length
), ranked AS (
    SELECT *, count(*) OVER (PARTITION BY doc_id) AS n_runs,
        NOT EXISTS (FROM runs o WHERE o.doc_id = r.doc_id AND (o.length * r.period > r.length * o.period
            OR (o.length * r.period = r.length * o.period AND (o.start < r.start OR (o.start = r.start AND o.period < r.period))))) AS best
    FROM runs r
), listed AS (
    SELECT doc_id, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM runs GROUP BY doc_id
), dropped AS (
    SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
    SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS t FROM words w LEFT JOIN dropped d ON d.doc_id = w.doc_id AND d.i = w.i WHERE d.i IS NULL GROUP BY w.doc_id
)
SELECT d.doc_id, coalesce(b.n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
    sha256(coalesce(l.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM docs d LEFT JOIN ranked b ON b.doc_id = d.doc_id AND b.best LEFT JOIN listed l ON l.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
""".replace("@CRC@", _CRC32.format("doc_id"))

_OP13 = """
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), c AS (
    SELECT conv_id, conv_id - conv_id % 5 AS base, @CRC@ % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
    SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
    UNION ALL SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h
), keyed AS (
    SELECT conv_id, row_number() OVER w AS depth, string_agg(md5(length(role) || ':' || role || text), '') OVER w AS key, octet_length(encode(text)) AS bytes
    FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), member AS (
    SELECT conv_id, depth, key, bytes FROM keyed UNION ALL SELECT conv_id, 0, '', 0 FROM c
), node AS (
    SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved, left(key, 32 * (depth - 1)::INT) AS parent FROM member GROUP BY key, depth
), children AS (
    SELECT parent AS key, count(*) AS n FROM node WHERE depth > 0 GROUP BY parent
), sized AS (
    SELECT node.*, coalesce(children.n, 0) AS n_children FROM node LEFT JOIN children USING (key)
), below AS (
    SELECT left(key, 32 * k::INT) AS key, saved, n_children FROM (SELECT *, unnest(range(depth + 1)) AS k FROM sized)
), summed AS (
    SELECT key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM below GROUP BY key
), ends AS (
    SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(key, depth) AS key FROM member GROUP BY conv_id) GROUP BY key
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM sized n JOIN summed s USING (key) LEFT JOIN node p ON p.key = n.parent AND n.depth > 0 LEFT JOIN ends e ON e.key = n.key
""".replace("@CRC@", _CRC32.format("conv_id"))

ORACLES: dict[str, str] = {"op1_warc": _OP1, "op10_line_runs": _OP10, "op11_periodic_runs": _OP11, "op13_prefix_trie": _OP13}
