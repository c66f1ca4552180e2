"""Registered queries of the operators, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm import byte_bpe, decontaminate, exact_dedup, fingerprint, lm_score, merkle, path_join, periodic, pii, quality, secret_scan, token_count, toxicity
from cohortspark.llm.text import id_fold, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ship_package(spark).read.parquet(f"{folder}/{name}.parquet")


def predictions(scored: DataFrame, least: float) -> DataFrame:
    held: Column = id_fold(F.col("doc_id")) == 0
    return scored.select(
        "doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= least, 1).otherwise(0).alias("predicted")
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_SQL = f"""
WITH t AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC) = 1 AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""

DECONTAMINATE_SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, len(g) AS n, array_to_string(g, ' ') AS g FROM (
    SELECT item_id, unnest([w[i:i + least(13, len(w)) - 1] FOR i IN range(1, len(w) - least(13, len(w)) + 2)]) AS g
    FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
own AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
"""


NEAR_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c)),
r(node, reached) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reached),
k AS (SELECT node AS doc_id, min(reached) AS class_id, count(*) AS class_size FROM r GROUP BY 1),
d AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT doc_id, class_id, class_size, coalesce(n_links, 0) AS n_links FROM k LEFT JOIN d USING (doc_id)
"""

# CRC-32 of the decimal doc_id, bit by bit.
_CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, [
    (ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::INT, 1)) >> (i % 8)::INT) & 1 FOR i IN range(8 * length(doc_id::VARCHAR))]::BIGINT[]),
    lambda c, m: xor(c >> 1, 3988292384 * (xor(c, m) & 1))), 4294967295)"""


def _leaf_sql(text: str) -> str:
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    return f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


MERKLE_SQL = f"""
WITH RECURSIVE found AS (
  SELECT *, CASE WHEN {_CRC_SQL} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS found_text FROM documents),
leaves AS (
  SELECT doc_id, source, {_leaf_sql("text")} AS leaf, {_leaf_sql("found_text")} AS found_leaf,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM found),
low(source, level, pos, n, h) AS (
  SELECT source, 0, pos, n, leaf FROM leaves
  UNION ALL
  SELECT source, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY ALL),
tops AS (
  SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high(level, pos, n, h) AS (
  SELECT 0, pos, n, h FROM tops
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY ALL),
heights AS (
  SELECT coalesce(source, '-') AS tree, max(level) AS height FROM low GROUP BY source
  UNION ALL SELECT '', max(level) FROM high),
nodes AS (
  SELECT coalesce(source, '-') AS tree, level, pos, h FROM low UNION ALL SELECT '', level, pos, h FROM high),
places AS (
  SELECT l.doc_id, coalesce(l.source, '-') AS own, l.leaf, l.found_leaf, l.pos, t.pos AS top_pos, t.h AS subroot, a.height, b.height AS top_height
  FROM leaves l JOIN tops t ON l.source IS NOT DISTINCT FROM t.source
  JOIN heights a ON a.tree = coalesce(l.source, '-') JOIN heights b ON b.tree = ''),
ways AS (
  SELECT doc_id, own AS tree, k AS step, k AS level, (pos // (3 ** k)::BIGINT)::BIGINT AS place
  FROM (SELECT *, unnest(range(height)) AS k FROM places)
  UNION ALL
  SELECT doc_id, '', height + k, k, (top_pos // (3 ** k)::BIGINT)::BIGINT
  FROM (SELECT *, unnest(range(top_height)) AS k FROM places)),
beside AS (
  SELECT w.doc_id, w.step,
         coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos < w.place), '') AS l,
         coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos > w.place), '') AS r
  FROM ways w JOIN nodes x ON x.tree = w.tree AND x.level = w.level AND x.pos // 3 = w.place // 3 GROUP BY ALL),
folds(doc_id, step, h) AS (
  SELECT doc_id, 0, found_leaf FROM places
  UNION ALL
  SELECT f.doc_id, f.step + 1, sha256(b.l || f.h || b.r) FROM folds f JOIN beside b ON b.doc_id = f.doc_id AND b.step = f.step),
proofs AS (SELECT doc_id, sha256(string_agg(l || r, '' ORDER BY step)) AS proof_sha256 FROM beside GROUP BY doc_id),
ends AS (SELECT doc_id, arg_max(h, step) AS folded_root FROM folds GROUP BY doc_id),
root AS (SELECT h FROM high WHERE n = 1)
SELECT p.doc_id, leaf, subroot, root.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root.h AS verified
FROM places p JOIN ends USING (doc_id) LEFT JOIN proofs USING (doc_id), root
"""


@query("op4_exact_dedup", EXACT_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Exact copies of documents and the row of each group that stays."""
    return exact_dedup.exact_duplicates(table(spark, folder, "documents")).drop("text_hash")


@query("op5_decontaminate", DECONTAMINATE_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows in documents."""
    found = decontaminate.contamination_report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("spans")


@query("op6_quality")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Quality scores of documents."""
    documents = table(spark, folder, "documents")
    weights = quality.train_quality(documents, table(spark, folder, "labels"))
    return predictions(quality.score_quality(documents, weights), 0.3)


@query("op7_byte_bpe")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of byte-level BPE tokens and of their decoding."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_documents(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)


@query("op8_token_count")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of documents."""
    return token_count.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op9_secrets")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in documents."""
    return secret_scan.scan_secrets(table(spark, folder, "documents")).drop("secrets")


@query("op10_path_join", NEAR_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate groups of documents and the number of links of each."""
    return path_join.near_duplicates(table(spark, folder, "documents")).drop("stays", "text_hash")


@query("op1_toxicity")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity scores of documents."""
    documents = table(spark, folder, "documents")
    lexicon = toxicity.train_lexicon(documents, table(spark, folder, "labels"))
    return predictions(toxicity.score_toxicity(documents, lexicon), 0.5)


@query("op3_lm_score")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Cross-entropy difference of documents: those labelled as good against all."""
    good = table(spark, folder, "labels").filter("quality = 1")
    documents = table(spark, folder, "documents")
    return lm_score.score_documents(documents, good, lm_score.train_models(documents))


@query("op2_pii")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in documents."""
    return pii.find_personal_data(table(spark, folder, "documents")).drop("found")


@query("op11_merkle_manifest", MERKLE_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Merkle proofs of documents, verified after line feeds were taken out of half of them."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    found = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.manifest(table(spark, folder, "documents"), found).drop("proof")


def planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the texts, by crc32 of the id, the words from one on repeat with some period."""
    own = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    hit = (F.pmod(own, F.lit(10)) == 0) & F.col("text").isNotNull()
    n, a, p = F.col("n"), F.col("a"), F.col("p")
    rows = docs.select("doc_id", "text", F.when(hit, words).alias("w"), F.floor(own / 10).alias("g"))
    rows = rows.withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(n > 0, F.pmod("g", n)))
    rows = rows.withColumn("p", 1 + F.floor((n - a) / (3 + F.pmod("g", F.lit(8)))))
    places = F.sequence(F.lit(0).cast("long"), n - 1)
    changed = F.transform(places, lambda i: F.get("w", F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")))
    return rows.select("doc_id", F.when(n > 0, F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated word sequences in documents, some of them planted."""
    found = periodic.find_runs(planted_runs(table(spark, folder, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))  # of ties the first
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    every = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    out = found.withColumn("b", best)
    length, period = F.col("b").getItem("length"), -F.col("b").getItem("col3")
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("b").getItem("col2")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(every, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op13_fingerprints")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of documents and of their edited texts, which end as the next document begins."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, folder, "documents").select("doc_id", text.alias("text"), F.xxhash64(text).alias("mark"))
    docs = fingerprint.with_next(fingerprint.with_sketch(docs, "text", "sketch"), ["text", "sketch"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next.text", F.lit(1), third))
    docs = docs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", F.col("next.sketch").alias("next_sketch"))
    docs = fingerprint.with_sketch(docs, "edited", "edited_sketch")
    own = F.col("sketch")
    return docs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.as_text(own).alias("fingerprint"),
        fingerprint.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprint.resemblance(own, F.col("edited_sketch")).alias("near_edited"),
        fingerprint.resemblance(own, F.col("next_sketch")).alias("near_next"),
    )
