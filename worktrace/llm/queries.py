"""The training-data queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrace.llm import fingerprints, line_dedup, minhash, mixing, packing, quality_fm, quality_rules, repair, simhash, token_counts, toxicity, warc, whitening
from worktrace.llm.common import read_table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("clean_text", "row")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_removed_units", "n_removed_chars", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints_with_next(read_table(spark, sf_dir, "documents"))


def op5_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_fm.score(docs, quality_fm.fit(docs, read_table(spark, sf_dir, "labels")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))
    return out.withColumn("n_toxic_sentences", F.size("sentences").cast("long")).drop("sentences")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derivatives of all pages, their blocks by length and digest."""
    out = warc.derivatives(warc.responses(read_table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return out.withColumn("content_length", F.octet_length("block").cast("long")).drop("block")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(read_table(spark, sf_dir, "documents")).drop("source")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whitened(vectors, whitening.fit(vectors))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(read_table(spark, sf_dir, "conversations"))).drop("n_rows")


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_line_dedup, op3_minhash, op4_fingerprints, op5_quality_fm, op6_toxicity, op7_packing, op8_token_counts,
        op9_warc, op10_mixing, op11_whitening, op12_simhash, op13_repair,
    )
}

def _repair_sql() -> str:
    """CRC-32 from its table, faults by windows, and the dynamic program as a recursion over rows with a state's cost, edits and lines."""

    def more(state: str, cost: str, edit: str, line: str = "''") -> str:
        return f"{{'c': {state}.c + {cost}, 'e': {state}.e || '{edit}', 't': {state}.t || {line}}}"

    least = lambda options: f"list_sort([{', '.join(options)}])[1]"
    never = "{'c': CAST(1000000000 AS BIGINT), 'e': '', 't': ''}"
    user, helper, own = "chr(10) || 'user:'", "chr(10) || 'assistant:'", "chr(10) || role || ':' || text"
    a2 = least(["s2", *[more(s, "3", "I", user) for s in ("s0", "s1", "s3")]])
    a3 = least(["s3", more("s2", "3", "I", helper), *[more(s, "6", "II", f"{user} || {helper}") for s in ("s0", "s1")]])
    # A row that has to go, or that the pattern does not take, costs too much to stay.
    keep = lambda initial: f"CASE WHEN fault IN (1, 2) OR left(role, 1) <> '{initial}' THEN 1000000 ELSE extra END"
    rerole = "CASE WHEN fault IN (1, 2) THEN 1000000 ELSE 3 + extra END"
    to_user = [x for s in ("a0", "a1", "a3") for x in (more(s, keep("u"), "K", own), more(s, rerole, "R", f"{user} || text"))]
    n1 = least([more("a1", "4", "D"), more("a0", keep("s"), "K", own)])
    n2 = least([more("a2", "4", "D"), *to_user])
    n3 = least([more("a3", "4", "D"), more("a2", keep("a"), "K", own), more("a2", rerole, "R", f"{helper} || text")])
    return f"""WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], list_transform(range(8), lambda z: 0)), lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
crc AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(
  string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) % 20 AS k FROM conversations, tab),
bad AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM crc WHERE k <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS b FROM bad),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS d, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM placed),
faulty AS (SELECT *, CASE WHEN b = '' THEN 1 WHEN d > 1 THEN 2 WHEN b[-1] NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM numbered),
turns AS (SELECT *, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS extra FROM faulty),
facts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (left(p, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY 1),
best AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'e': '', 't': ''}} AS s0, {never} AS s1, {never} AS s2, {never} AS s3 FROM conversations UNION ALL
SELECT conv_id, i, {more("a0", "4", "D")}, {n1}, {n2}, {n3} FROM (SELECT t.*, s0 AS a0, s1 AS a1, {a2} AS a2, {a3} AS a3 FROM best JOIN turns t ON t.conv_id = best.conv_id AND t.i = best.i + 1)),
last AS (SELECT b.conv_id, f.* EXCLUDE (conv_id, n), {least(["s0", "a3"])} AS x FROM (SELECT *, {a3} AS a3 FROM best) b LEFT JOIN facts f USING (conv_id) WHERE b.i = coalesce(n, 0))
SELECT conv_id, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))}, CAST(x.c AS BIGINT) AS cost, x.e AS audit, sha256(substr(x.t, 2)) AS repaired_sha256 FROM last"""


ORACLES: dict[str, str] = {"op13_repair": _repair_sql()}
