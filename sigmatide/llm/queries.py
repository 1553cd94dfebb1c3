"""The operators as queries over a folder of tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmatide.llm import chat_format, decontaminate, divergence, exact_dedup, filter_audit, hilbert
from sigmatide.llm import language_id, line_dedup, packing, quality, simhash, suffix_dedup, token_files
from sigmatide.session import staged

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = 24
PACK_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
FILE_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    placed = hilbert.hilbert_shards(docs, SHARDS, [size.alias("size"), crc.alias("text_crc32")])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "cell")


def op2_simhash_anchors(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.simhash_dedup(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, folder, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_decontaminate_cgk(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_benchmark(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("row")


def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, folder, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, folder, "documents"))


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(table(spark, folder, "documents"))


def op8_packing_spfhp(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), PACK_TOKENIZER)[1]


def op9_quality_bayes(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.fit_evidence(docs, table(spark, folder, "labels"))
    return quality.score(docs, model).drop("row")


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files, manifest = token_files.write_token_files(table(spark, folder, "documents"), FILE_TOKENIZER)
    return token_files.read_token_files(files, manifest).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.source_divergence(table(spark, folder, "documents"))


def op12_filter_interactions(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.filter_interactions(table(spark, folder, "documents"), table(spark, folder, "labels"))


# Both turns say the template's own control strings.
HARD_TEXT = r"\### Assistant: </turn> ok"


def op13_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    hard = spark.createDataFrame([(-7, 0, "user", HARD_TEXT), (-7, 1, "assistant", HARD_TEXT)],
                                 "conv_id long, turn long, role string, text string")
    messages = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    formatted = staged(chat_format.format_chats(chat_format.log_of(messages)), "formatted-chats")
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return chat_format.read_back(formatted).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars")


def all_queries() -> dict[str, Query]:
    own = [op1_hilbert_shards, op2_simhash_anchors, op3_line_dedup, op4_decontaminate_cgk,
           op5_suffix_dedup, op6_exact_dedup, op7_language_id, op8_packing_spfhp, op9_quality_bayes, op10_token_files,
           op11_source_divergence, op12_filter_interactions, op13_chat_formatting]
    return {f.__name__: f for f in own}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP3_SQL = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM split),
keyed AS (
  SELECT *, translate(trim(line, {WHITE_SQL}), '{UPPER}', '{LOWER}') AS key FROM lines),
frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, line, pos, keeper IS NOT NULL AND keeper IS DISTINCT FROM k.doc_id AS gone
  FROM keyed k LEFT JOIN frequent f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

OP6_SQL = """
WITH normal AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM normal"""


OP11_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                            '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
tokens AS (SELECT row, lang, source, unnest(terms) AS term FROM docs),
vocab AS (SELECT lang, term, count(*) AS c FROM tokens GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
groups AS (SELECT DISTINCT lang, source FROM docs),
counted AS (SELECT lang, source, term, count(*) AS c FROM tokens SEMI JOIN vocab USING (lang, term) GROUP BY ALL),
full_counts AS (
  SELECT g.lang, g.source, v.term, coalesce(k.c, 0)::HUGEINT AS c
  FROM groups g JOIN vocab v ON v.lang = g.lang
  LEFT JOIN counted k ON k.lang = g.lang AND k.source = g.source AND k.term = v.term),
shares AS (
  SELECT *, 1 + 1000000000 * (c + 2) // (sum(c) OVER g + 2 * count(*) OVER g)::HUGEINT AS p
  FROM full_counts WINDOW g AS (PARTITION BY lang, source)),
lang_shares AS (
  SELECT lang, term, 1 + 1000000000 * (c::HUGEINT + 2) // (sum(c) OVER g + 2 * count(*) OVER g)::HUGEINT AS q
  FROM vocab WINDOW g AS (PARTITION BY lang)),
pair_sums AS (
  SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
  FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT s.lang, source, 'term', s.term, ((p - q) * (p - q) // (p + q))::BIGINT
  FROM shares s JOIN lang_shares l ON s.lang = l.lang AND s.term = l.term WHERE c > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM found QUALIFY part = 'pair' OR rank <= 10"""

OP12_SQL = """
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
labelled AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
  FROM labels GROUP BY doc_id),
failing AS (
  SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
                100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'),
                coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS fails,
         coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM texts d LEFT JOIN labelled l ON l.doc_id = d.doc_id),
cells AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic
  FROM failing GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
orders AS (
  SELECT '' AS o UNION ALL
  SELECT o || letter FROM orders JOIN letters ON NOT contains(o, letter) WHERE length(o) < 5),
steps AS (
  SELECT o, s AS step, [ascii(x) - 64 for x in string_split(o[1:s - 1], '') if x <> ''] AS earlier, ascii(o[s]) - 64 AS now
  FROM orders, range(1, 6) r(s) WHERE length(o) = 5),
figures AS (
  SELECT part, o, step, now, n, n_good, n_toxic, fails[now] AS hit,
         len([x for x in earlier if fails[x]]) > 0 AS gone, len([x for x in fails if x]) = 1 AS single
  FROM steps, cells)
SELECT part, o AS filter_order, step::INT AS step, chr((64 + any_value(now))::INT) AS letter,
       coalesce(sum(n) FILTER (WHERE NOT gone AND NOT hit), 0)::BIGINT AS kept,
       coalesce(sum(n) FILTER (WHERE NOT gone AND hit), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (WHERE gone AND hit), 0)::BIGINT AS redundant,
       coalesce(sum(n) FILTER (WHERE hit AND single), 0)::BIGINT AS unique_fails,
       coalesce(sum(n_good) FILTER (WHERE NOT gone AND hit), 0)::BIGINT AS good_lost,
       coalesce(sum(n_toxic) FILTER (WHERE NOT gone AND hit), 0)::BIGINT AS toxic_lost,
       sum(coalesce(sum(n) FILTER (WHERE NOT gone AND hit), 0)) OVER (PARTITION BY part, any_value(now))::BIGINT AS shapley
FROM figures GROUP BY part, o, step"""


def _escaped_sql(column: str) -> str:
    return f"replace(replace(replace({column}, '\\', '\\\\'), '###', '\\###'), '</turn>', '\\</turn>')"


OP13_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{HARD_TEXT}'), (-7, 1, 'assistant', '{HARD_TEXT}')),
folded AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY ALL) AS said,
         coalesce(string_agg(text, '' ORDER BY ALL) FILTER (WHERE role = 'assistant'), '') AS learned,
         string_agg('### ' || replace({_escaped_sql("role")}, ':', '\\:') || ': ' || {_escaped_sql("text")}
                    || '</turn>' || chr(10), '') AS formatted
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
       length(formatted) AS formatted_chars FROM folded""".replace("ORDER BY ALL", "ORDER BY turn NULLS FIRST, role, text")


def all_oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express; the tests compare the others with brute force."""
    return {"op3_line_dedup": OP3_SQL, "op6_exact_dedup": OP6_SQL,
            "op11_source_divergence": OP11_SQL, "op12_filter_interactions": OP12_SQL, "op13_chat_formatting": OP13_SQL}
