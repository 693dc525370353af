"""One query per corpus operator, with production parameters, over whole tables; and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmap.llm.common import table
from driftmap.llm.decontaminate import contamination
from driftmap.llm.embedding_dedup import near_vectors
from driftmap.llm.fill_middle import fill_in_middle, restored
from driftmap.llm.mixing import plan_mix
from driftmap.llm.near_dedup import near_duplicates
from driftmap.llm.secret_scan import listed, scan
from driftmap.llm.sharding import interleave, text_bytes, text_crc32
from driftmap.llm.suffix_dedup import remove_repeats
from driftmap.llm.token_files import read_tokens, write_tokens
from driftmap.llm.topk import scaled, top_k
from driftmap.llm.toxicity import fit, score
from driftmap.llm.vector_codes import code_vectors, whole_numbers
from driftmap.llm.warc import read_archives, write_archives
from driftmap.operators.scale import scratch_path


#: Score from which a document counts as toxic.
THRESHOLD = 0.3


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents to target weights takes of each document, and the shards they go to."""
    plan = plan_mix(table(spark, sf_dir, "documents"), carry=["doc_id"], shards=_MIX_SHARDS)
    taken = (F.col("size") * F.size("draws")).cast("bigint")
    shards = F.array_join(F.transform(F.array_sort("draws"), lambda d: d["shard"].cast("string")), ",")
    return plan.select("doc.doc_id", "size", "source_size", "target", taken.alias("taken"), shards.alias("shards"))


_MIX_SHARDS = 16


def _tree_level(level: int) -> str:
    """One level of the splitting tree in SQL: the smallest coins of a node go to its left half."""
    half = _MIX_SHARDS >> (level + 1)
    return f"""
coins{level} AS (
  SELECT *, row_number() OVER (PARTITION BY first_ ORDER BY md5(concat_ws(':', 'mix', first_, {2 * half}, label, number)),
                                                            label, number) - 1 AS rank,
         count(*) OVER (PARTITION BY first_) AS total
  FROM nodes{level}),
nodes{level + 1} AS (
  SELECT label, number, first_ + CASE WHEN rank < total * {half} // {2 * half} THEN 0 ELSE {half} END AS first_
  FROM coins{level}),"""


_OP1_SQL = (
    r"""
WITH n AS (SELECT CAST(greatest(1, ceil(sqrt(count(*)))) AS BIGINT) AS blocks FROM documents),
rows_ AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS label,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce('=' || doc_id::VARCHAR, '-') || ':' || coalesce('=' || text, '-')) AS key
  FROM documents),
keyed AS (SELECT rows_.*, CAST('0x' || substr(key, 1, 8) AS BIGINT) % blocks AS block FROM rows_, n),
units AS (SELECT source, label, block, sum(size)::BIGINT AS words FROM keyed GROUP BY ALL),
sizes AS (SELECT source, label, sum(words)::BIGINT AS source_size FROM units GROUP BY ALL),
weighed AS (
  SELECT *, 2.0::DOUBLE * source_size AS full_,
         ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sizes),
levels AS (
  SELECT *, row_number() OVER (ORDER BY full_ / weight, label) AS place,
         (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
           - coalesce(sum(full_) OVER (ORDER BY full_ / weight, label
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY full_ / weight, label ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
open_ AS (SELECT arg_min(level, place) AS open_level FROM levels WHERE level * weight <= full_),
targets AS (
  SELECT label, source_size, coalesce(least(full_, open_level * weight), full_) AS target FROM levels, open_),
drawn AS (
  SELECT u.label, u.block, t.source_size, t.target, c.copy,
         t.target - coalesce(sum(u.words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS limit_,
         row_number() OVER o - 1 AS number
  FROM units u JOIN targets t USING (label), (VALUES (0), (1)) c(copy)
  WINDOW o AS (PARTITION BY u.label
               ORDER BY c.copy, md5('mix:' || c.copy::VARCHAR || ':' || u.label || ':' || u.block::VARCHAR), u.block)),
nodes0 AS (SELECT label, number, 0 AS first_ FROM drawn WHERE limit_ > 0),"""
    + "".join(_tree_level(level) for level in range(4))
    + r"""
dealt AS (
  SELECT label, first_ AS shard, row_number() OVER (PARTITION BY label ORDER BY first_) - 1 AS number FROM nodes4),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY label, block ORDER BY key, size
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0 AS middle
  FROM keyed),
seen AS (
  SELECT p.doc_id, p.size, d0.source_size, d0.target,
         CASE WHEN d0.limit_ > 0 AND p.middle <= d0.limit_ THEN s0.shard END AS shard0,
         CASE WHEN d1.limit_ > 0 AND p.middle <= d1.limit_ THEN s1.shard END AS shard1
  FROM placed p
  JOIN drawn d0 ON d0.label = p.label AND d0.block = p.block AND d0.copy = 0
  JOIN drawn d1 ON d1.label = p.label AND d1.block = p.block AND d1.copy = 1
  LEFT JOIN dealt s0 ON s0.label = d0.label AND s0.number = d0.number
  LEFT JOIN dealt s1 ON s1.label = d1.label AND s1.number = d1.number)
SELECT doc_id, size, source_size, target,
       (size * ((shard0 IS NOT NULL)::INT + (shard1 IS NOT NULL)::INT))::BIGINT AS taken,
       concat_ws(',', shard0, shard1) AS shards
FROM seen
"""
)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as archives with revisits and read back."""
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    number = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(-?\d*)>$", 1), F.lit("")).cast("bigint")
    return read_archives(spark, path).select(
        number(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        number(F.col("refers_to")).alias("refers_to"),
    )


_OP2_SQL = """
WITH d AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: pattern matches and runs of high entropy."""
    found = scan(table(spark, sf_dir, "documents"), carry=["doc_id"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc.doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written as token files and read back."""
    path = scratch_path(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path)


def toxic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that may be learned from: those of ids whose checksum modulo 4 is not 2."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return labels.filter(~_held_out(F.col("doc_id")))


def _held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    scores = score(docs, fit(docs, toxic_labels(spark, sf_dir)), carry=["doc_id"])
    return scores.select(
        "doc.doc_id",
        _held_out(F.col("doc.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op6_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of equal counts, each with the mixture of sources of the whole."""
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    shards = interleave(docs, 40, carry=["doc_id"], size=text_bytes(text) + 16, text_crc32=text_crc32(text))
    return shards.select(
        "doc.doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share four fifths of their shingles of four words."""
    groups = near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)
    return groups.select("doc_id", "n_shingles", "component_id", "kept")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in passages of the benchmark."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p
        FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p
        FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT DISTINCT doc_id, n, p, win FROM dw SEMI JOIN bw USING (n, win)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h JOIN bw USING (n, win)) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("bigint").alias("id"), scaled(F.col("embedding")).alias("vector")
    )
    return top_k(vectors, F.col("id") % 20 == 0, k=20)


_OP9_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


def op10_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the strings of 200 bytes that occur twice."""
    return remove_repeats(table(spark, sf_dir, "documents"), length=200)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents rearranged to fill in their middle, and rebuilt."""
    moved = fill_in_middle(table(spark, sf_dir, "documents"), carry=["doc_id"])
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    rebuilt = restored(moved.withColumn("output_sha256", digest("output")))
    return rebuilt.select(
        "doc.doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", digest("restored").alias("restored_sha256")
    )


_OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
g AS (
  SELECT *, list_transform([1, 9, 17, 25], lambda p: CAST('0x' || substr(h, p, 8) AS BIGINT)) AS w FROM d),
f AS (
  SELECT doc_id, t, n, least(w[1] % (n + 1), w[2] % (n + 1)) AS a, greatest(w[1] % (n + 1), w[2] % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR w[3] % 100 >= 90 THEN 'plain'
              WHEN w[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
o AS (
  SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM o
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as four codes of one byte, with their errors."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "label", whole_numbers(F.col("embedding")).alias("vector")
    )
    coded = code_vectors(vectors, parts=4, entries=256, rounds=4)
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


_OP12_SQL = (
    """
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT vec_id, label, part, v[part * len(v) // 4 + 1:(part + 1) * len(v) // 4]::DOUBLE[] AS x
  FROM k, (SELECT unnest(range(0, 4)) AS part)),
b0 AS (
  SELECT part, e, x FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e FROM p)
  WHERE e < 256),"""
    + "".join(
        f"""
a{i} AS (
  SELECT vec_id, any_value(label) AS label, part, any_value(p.x) AS x,
         min(struct_pack(d := list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, b{i}.x)
                                + list_dot_product(b{i}.x, b{i}.x), e := e)) AS best
  FROM p JOIN b{i} USING (part) GROUP BY vec_id, part),"""
        + f"""
s{i} AS (
  SELECT part, e, list(mean ORDER BY place) AS x FROM (
    SELECT part, best.e AS e, place, floor(sum(value) / count(*)) AS mean
    FROM (SELECT part, best, unnest(x) AS value, unnest(range(0, len(x))) AS place FROM a{i}) GROUP BY ALL)
  GROUP BY part, e),
b{i + 1} AS (SELECT part, e, coalesce(s{i}.x, b{i}.x) AS x FROM b{i} LEFT JOIN s{i} USING (part, e)),"""
        * (i < 4)
        for i in range(5)
    )
    + """
h AS (
  SELECT sha256(string_agg(value::BIGINT::VARCHAR, ',' ORDER BY part, e, place)) AS codebooks_sha256
  FROM (SELECT part, e, unnest(x) AS value, unnest(range(0, len(x))) AS place FROM b4)),
c AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code,
         sum(best.d)::BIGINT AS error FROM a4 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c, h
"""
)


def op13_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of vectors of one label with a cosine of 0.93 or more."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    groups = near_vectors(vectors, threshold=0.93)
    return groups.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


_OP13_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(embedding) > 0 AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT a AS id, b AS other FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.other),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a),
c AS (SELECT id AS vec_id, min(other) AS low FROM r GROUP BY id)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, low) AS component_id,
       vec_id = least(vec_id, low) AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_warc": op2_warc,
    "op3_secrets": op3_secrets,
    "op4_token_files": op4_token_files,
    "op5_toxicity": op5_toxicity,
    "op6_interleave": op6_interleave,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_decontaminate": op8_decontaminate,
    "op9_top_k": op9_top_k,
    "op10_remove_repeats": op10_remove_repeats,
    "op11_fill_middle": op11_fill_middle,
    "op12_vector_codes": op12_vector_codes,
    "op13_embedding_duplicates": op13_embedding_duplicates,
}

ORACLES = {
    "op1_mix_sources": _OP1_SQL,
    "op2_warc": _OP2_SQL,
    "op8_decontaminate": _OP8_SQL,
    "op9_top_k": _OP9_SQL,
    "op11_fill_middle": _OP11_SQL,
    "op12_vector_codes": _OP12_SQL,
    "op13_embedding_duplicates": _OP13_SQL,
}
