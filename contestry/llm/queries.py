"""The registered queries of this subpackage and the SQL of those that SQL can express."""

import public_tokenizers
from pyspark.sql import functions as F

from contestry.llm import align, bpe, chat, cuckoo, fingerprint, lines, minhash, mixing, packing, periodic, pst, quality, toxicity
from contestry.llm.words import SPACE_CLASS


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer() -> dict:
    """The parameters of the packing operator that name the public vocabulary."""
    return {"json_path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op1_suffix_tree(spark, sf_dir):
    return pst.score(spark, documents(spark, sf_dir))


def op2_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), **tokenizer())


def op3_exact_dedup(spark, sf_dir):
    return cuckoo.dedup(spark, documents(spark, sf_dir))


def op4_toxicity(spark, sf_dir):
    return toxicity.predictions(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_quality(spark, sf_dir):
    return quality.predictions(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_mixing(spark, sf_dir):
    out = mixing.replicate(spark, documents(spark, sf_dir), numbered=True)
    return out.select("doc_id", "source", "copy_no", "n_copies", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("text_sha256"))


def op7_chat_format(spark, sf_dir):
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(spark, chat.format_windows(spark, turns))


def op8_line_dedup(spark, sf_dir):
    return lines.drop_lines(spark, documents(spark, sf_dir), min_docs=10, min_chars=1)


def op9_fingerprint(spark, sf_dir):
    return fingerprint.fingerprints(spark, documents(spark, sf_dir))


def op10_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(spark, documents(spark, sf_dir))


def op11_bpe(spark, sf_dir):
    ranks = {"ranks_path": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
    out = bpe.decode(bpe.encode(documents(spark, sf_dir), **ranks), **ranks)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


def op12_alignment(spark, sf_dir):
    vocabularies = {"ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN, "model_path": public_tokenizers.path("piece_bpe_32k.model")}
    out = align.alignment(spark, documents(spark, sf_dir), **vocabularies)
    digest = F.when(F.col("n_a") > 0, F.sha2(F.encode("groups", "UTF-8"), 256)).otherwise("")
    return out.withColumn("groups_sha256", digest).drop("groups")


def _with_periods(docs):
    """Every tenth document, by the checksum of its id, repeats a stretch of its words up to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", SPACE_CLASS + "+"), lambda w: w != "")
    docs = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).alias("g"))
    docs = docs.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    n, a, p = F.col("n"), F.col("a"), F.col("p")
    again = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
    return docs.select("doc_id", F.when(n > 0, F.concat_ws(" ", again)).otherwise(F.col("text")).alias("text"))


def op13_periodic(spark, sf_dir):
    out = periodic.periodic_runs(_with_periods(documents(spark, sf_dir)))
    # Runs come by start and period; exponents are compared as products, so equal ones leave the first.
    best = F.expr("aggregate(runs, runs[0], (a, r) -> IF(r.length * a.period > a.length * r.period, r, a))")
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    out = out.withColumn("best", F.when(F.size("runs") > 0, best))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.encode(lines, "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


Q = {f.__name__: f for f in (op1_suffix_tree, op2_packing, op3_exact_dedup, op4_toxicity, op5_quality, op6_mixing, op7_chat_format, op8_line_dedup, op9_fingerprint, op10_near_dedup, op11_bpe, op12_alignment, op13_periodic)}

_BARE = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"
_KEY = r"translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op3_exact_dedup": f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256({_BARE}) AS text_sha256 FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g""",
    "op6_mixing": """
WITH s AS (SELECT coalesce(source, '') AS k, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT k, 1.0::DOUBLE / (SELECT count(*) FROM s)::DOUBLE * (SELECT sum(n) FROM s)::DOUBLE / n AS rate FROM s),
j AS (SELECT k, rate, unnest(range(0, (rate + sqrt(rate) * 12 + 24)::INT + 1)) AS i FROM r),
c AS (SELECT k, sum(exp(-rate) * pow(rate, i) / gamma(i + 1)) OVER (PARTITION BY k ORDER BY i) AS cdf FROM j),
d AS (SELECT doc_id, source, text, coalesce(source, '') AS k,
             ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
m AS (SELECT d.*, (SELECT count(*) FROM c WHERE c.k = d.k AND c.cdf <= d.u) AS n_copies FROM d)
SELECT doc_id, source, unnest(range(1, n_copies + 1)) AS copy_no, n_copies, sha256(coalesce(text, '')) AS text_sha256 FROM m""",
    "op8_line_dedup": f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, {_KEY} AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
f AS (SELECT k.doc_id, k.line, k.i, c.key IS NOT NULL AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM f GROUP BY doc_id""",
}
