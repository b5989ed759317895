"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, brown, chat, collisions, exchanging, langid, licenses, packing, phrases, pii, quality, toxicity
from corvane.llm.minhash import near_duplicates


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies: in the folder of the ``public_tokenizers`` package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    field = toxicity.learn(docs, table(spark, sf_dir, "labels"), usable=F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1)
    out = toxicity.scored(docs, field)
    return out.select("doc_id", F.coalesce(third, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.CUTOFF).cast("int").alias("predicted"), "span_starts", "span_ends")


#: Schemas of the two tools that derived calls name: ``(tool, param, type, required)``.
TOOLS = [("count", "n", "integer", True), ("count", "after", "object", False), ("find", "n", "string", True), ("find", "after", "object", False)]


def with_calls(turns: DataFrame) -> DataFrame:
    """The turns, and calls and results that follow from them, as the tables hold plain text only.

    Every assistant turn ``t`` also makes the call ``ct``.  With ``u = t div 2``: it names ``find`` if ``u mod 5 = 4``, else ``count``; its argument
    is the length of the turn's text, called ``m`` if ``u mod 6 = 5``, else ``n``; unless ``u mod 4 = 3`` it needs the result of the call two turns later, if there is one.
    Every user turn ``t`` but the first is also the result of the call ``c(t - 1)``, whether or not there is one.
    """
    t, u = F.col("turn"), F.floor(F.col("turn") / 2)
    n = F.coalesce(F.char_length("text"), F.lit(0)).cast("string")
    needs = F.when(u % 4 == 3, "").otherwise(F.concat(F.lit(',"after":{"$result":"c'), (t + 2).cast("string"), F.lit('"}')))
    name, arg = F.when(u % 5 == 4, "find").otherwise("count"), F.when(u % 6 == 5, "m").otherwise("n")
    called = F.concat(F.lit('{"tool_calls":[{"id":"c'), t.cast("string"), F.lit('","name":"'), name, F.lit('","arguments":{"'), arg, F.lit('":'), n, needs, F.lit("}}]}"))
    given = F.concat(F.lit('{"tool_call_id":"c'), (t - 1).cast("string"), F.lit('","content":"'), n, F.lit('"}'))
    said = turns.select("conv_id", "turn", "role", F.col("text").cast("string").alias("text"))
    calls = said.filter("role = 'assistant'").withColumn("text", called)
    return said.unionByName(calls).unionByName(said.filter("role = 'user' AND turn > 0").withColumn("text", given))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = spark.createDataFrame(TOOLS, "tool string, param string, type string, required boolean")
    return chat.formatted(with_calls(table(spark, sf_dir, "conversations")), tools)


def op4_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return packing.packed(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.coded(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.scores(table(spark, sf_dir, "documents"), clustered=exchanging.clustered)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents")).drop("places")


def op11_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    fourth = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.filter(~fourth))
    out = langid.predicted(docs, model)
    return out.select("doc_id", fourth.alias("held_out"), "lang_pred", "score", "n_words", "n_known")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_toxicity": op2_toxicity,
    "op3_chat": op3_chat,
    "op4_collisions": op4_collisions,
    "op5_packing": op5_packing,
    "op6_quality": op6_quality,
    "op7_pii": op7_pii,
    "op8_bpe": op8_bpe,
    "op9_brown": op9_brown,
    "op10_licenses": op10_licenses,
    "op11_langid": op11_langid,
    "op12_phrases": op12_phrases,
}

ORACLES: dict[str, str] = {
    "op3_chat": """
WITH t AS (SELECT conv_id, turn, role, text, turn // 2 AS u, coalesce(length(text), 0) AS n FROM conversations),
calls AS (SELECT c.*, c1.turn IS NOT NULL AND c.u % 4 < 3 AS one, c1.u % 4 < 3 AND c2.turn IS NOT NULL AS two, c2.u % 4 < 3 AND c3.turn IS NOT NULL AS three, r.turn IS NOT NULL AS linked
  FROM t c LEFT JOIN t c1 ON c1.conv_id = c.conv_id AND c1.role = 'assistant' AND c1.turn = c.turn + 2 LEFT JOIN t c2 ON c2.conv_id = c.conv_id AND c2.role = 'assistant' AND c2.turn = c.turn + 4
  LEFT JOIN t c3 ON c3.conv_id = c.conv_id AND c3.role = 'assistant' AND c3.turn = c.turn + 6 LEFT JOIN t r ON r.conv_id = c.conv_id AND r.role = 'user' AND r.turn = c.turn + 1 WHERE c.role = 'assistant'),
placed AS (SELECT *, CASE WHEN NOT one THEN 0 WHEN NOT two THEN 1 WHEN NOT three THEN 2 ELSE 3 END AS level FROM calls)
SELECT conv_id, turn, 0 AS idx, 'message' AS kind, role, NULL::VARCHAR AS call_id, NULL::BOOLEAN AS linked, true AS valid, '' AS problems, turn AS at, 0 AS level, 0 AS step,
  '{' || concat_ws(',', '"content":' || to_json(text)::VARCHAR, '"role":' || to_json(role)::VARCHAR) || '}' AS json FROM t
UNION ALL
SELECT conv_id, turn, 0, 'message', role, NULL, NULL, true, '', turn, 0, 0, '{"role":"assistant"}' FROM calls
UNION ALL
SELECT conv_id, turn, 1, 'call', role, 'c' || turn, linked, u % 6 <> 5 AND u % 5 <> 4, CASE WHEN u % 6 = 5 THEN 'missing n; unexpected m' WHEN u % 5 = 4 THEN 'type of n' ELSE '' END, turn + 2 * level, level, 1,
  '{"arguments":{' || CASE WHEN u % 4 = 3 THEN '' ELSE '"after":{"$result":"c' || (turn + 2) || '"},' END || CASE WHEN u % 6 = 5 THEN '"m":' ELSE '"n":' END || n
  || '},"id":"c' || turn || '","name":"' || CASE WHEN u % 5 = 4 THEN 'find' ELSE 'count' END || '","role":"assistant","type":"call"}' FROM placed
UNION ALL
SELECT t.conv_id, t.turn, 0, 'result', t.role, 'c' || (t.turn - 1), c.turn IS NOT NULL, c.turn IS NOT NULL, CASE WHEN c.turn IS NULL THEN 'no call' ELSE '' END, greatest(t.turn, coalesce(c.turn + 2 * level, t.turn)), coalesce(level, 0), 2,
  '{"content":"' || t.n || '","id":"c' || (t.turn - 1) || '","role":"user","type":"result"}'
FROM t LEFT JOIN placed c ON c.conv_id = t.conv_id AND c.turn = t.turn - 1 WHERE t.role = 'user' AND t.turn > 0
""",
    "op10_licenses": licenses.oracle(),
    "op12_phrases": phrases.oracle(),
}
