"""The queries of the corpus operators, as the driver runs them."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.llm import bpe, conversations, hardneg, licenses, media, mixing, neardup, packing, pii, quality, secrets, topk, urls
from postmill.llm.common import read, spread, stored


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_exact_topk(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").where(topk.finite(F.col("embedding"))).select(F.col("vec_id").cast("bigint").alias("vec_id"), topk.quantised(F.col("embedding")).alias("weights"))
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op2_url_filter(spark, sf_dir):
    return urls.filter_urls(read(spark, sf_dir, "pages"))


def op3_secret_scan(spark, sf_dir):
    return secrets.digest(secrets.scan(spread(read(spark, sf_dir, "documents").select("doc_id", "text"))))


def op4_source_mix(spark, sf_dir):
    rows = stored(mixing.sized(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "source", "key", "hash", "own", "size"), "mix-sizes")
    taken = mixing.mixed(rows, mixing.plan(rows.drop("doc_id")))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_license_scan(spark, sf_dir):
    return licenses.scan(spread(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_quality(spark, sf_dir):
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text"))
    model = quality.learn(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_pii(spark, sf_dir):
    return pii.digest(pii.scan(spread(read(spark, sf_dir, "documents").select("doc_id", "text")), keep=["doc_id"]))


def op8_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), size=2).drop("copies")


def op9_media(spark, sf_dir):
    stored_texts = media.store_text(read(spark, sf_dir, "documents")).withColumn("said", F.lit("application/octet-stream"))
    payload = F.col("payload")
    crc = F.crc32(F.substring(payload, F.length(payload) - media.BLOCK + 1, F.lit(media.BLOCK)))
    feature = F.concat_ws(";", F.col("type"), F.concat(F.lit("corrected="), F.col("corrected").cast("string")), F.concat(F.lit("embedded="), F.array_join(F.transform("embedded", lambda e: F.concat_ws(":", e["type"], e["offset"].cast("string"), e["length"].cast("string"))), ",")))
    return (
        media.sniff(stored_texts, "media", "said")
        .withColumn("payload", media.samples())
        .select("doc_id", "n_bytes", F.length(payload).cast("bigint").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), crc.alias("tail_crc32"), F.length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))
    )


def op10_packing(spark, sf_dir):
    packed = packing.pack(read(spark, sf_dir, "documents"), tokenizer())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    usable = read(spark, sf_dir, "embeddings").where(topk.finite(F.col("embedding")) & F.col("label").isNotNull())
    vectors = usable.select(F.col("vec_id").cast("bigint").alias("vec_id"), label.alias("label"), topk.quantised(F.col("embedding"), 256).alias("weights"))
    return hardneg.mine(vectors, vectors.where("vec_id % 100 = 0"))


def op12_conversation_repair(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    # damage drops all rows of a turn or none, so turns tell the gaps and which conversations there were
    turns = rows.select(F.col("conv_id").cast("bigint").alias("own"), F.col("turn").cast("bigint").alias("turn"), (conversations.damage_kind() != 0).alias("stays"))
    turns = turns.groupBy("own", "turn").agg(F.max("stays").alias("stays")).withColumn("turn", F.when(F.col("stays"), F.col("turn")))
    every = turns.groupBy("own").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    repaired = conversations.summary(conversations.repair(conversations.damage(rows)))
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    audit, sha = F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return every.join(repaired, F.col("own").eqNullSafe(F.col("conv_id")), "left").select(F.col("own").alias("conv_id"), "gaps", *numbers, audit, sha)


def op13_bpe(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, tokenizer(), bpe.lexicon(docs, tokenizer())).select("doc_id", "ids")
    decoded = bpe.decode(coded, tokenizer())
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_exact_topk, op2_url_filter, op3_secret_scan, op4_source_mix, op5_license_scan, op6_quality, op7_pii, op8_near_duplicates, op9_media, op10_packing, op11_hard_negatives, op12_conversation_repair, op13_bpe)}
