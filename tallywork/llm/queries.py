"""The operators on the given tables: each query maps a table to page records, and the results back.

QUERIES has the functions, ORACLE their SQL twins where SQL can express them.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.llm import (
    benchmark_leaks, boilerplate, byte_bpe, filter_audit, fingerprints, license_scan, mixing, near_duplicates, quality_model,
    quality_rules, spelling, token_files, warc,
)
from tallywork.session import scratch_path, write_scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def as_pages(documents: DataFrame, *more: str) -> DataFrame:
    """Documents as page records: the id names the page, the text is its html."""
    return documents.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"), *more)


def as_documents(result: DataFrame) -> DataFrame:
    return result.withColumnRenamed("page_id", "doc_id")


@query("op1_token_files")
def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = token_files.write_token_files(
        as_pages(table(spark, folder, "documents")), scratch_path(spark, "tokens"), WORD_BPE, markers=True)
    return as_documents(token_files.read_token_files(files)).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


_OP2_SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS text FROM documents
), lines AS (
  SELECT doc_id, source, place, parts[place] AS raw, trim(parts[place], ' ' || chr(9) || chr(13)) AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS place FROM base)
), spread AS (
  SELECT line, count(DISTINCT source) AS sites, min((doc_id, place)) AS first FROM lines WHERE line <> '' GROUP BY line
), marked AS (
  SELECT l.doc_id, l.place, l.raw,
         coalesce(l.line <> '' AND s.sites >= 10 AND (l.doc_id, l.place) <> s.first, false) AS gone
  FROM lines l LEFT JOIN spread s ON l.line = s.line AND l.line <> ''
)
SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS text,
       count(*) FILTER (WHERE gone) AS n_removed
FROM marked GROUP BY doc_id
"""


@query("op2_line_dedup", _OP2_SQL)
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    pages = as_pages(table(spark, folder, "documents"), F.col("source").alias("site"))
    return boilerplate.remove_boilerplate(pages).select(
        F.col("page_id").alias("doc_id"), F.col("html").alias("text"), "n_removed")


_OP3_SQL = r"""
WITH RECURSIVE base AS (
  SELECT doc_id, md5(coalesce(text, '')) AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), texts AS (
  SELECT t, any_value(w) AS w FROM base GROUP BY t
), sh AS (
  SELECT DISTINCT t, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT t, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM texts WHERE len(w) > 0)
), n AS (
  SELECT t, count(*) AS n FROM sh GROUP BY t
), shared AS (
  SELECT a.t AS x, b.t AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.t <> b.t GROUP BY 1, 2
), link AS (
  SELECT x, y FROM shared JOIN n nx ON nx.t = x JOIN n ny ON ny.t = y WHERE 5 * k >= 4 * (nx.n + ny.n - k)
  UNION ALL
  SELECT a.t, b.t FROM texts a JOIN texts b ON a.t <> b.t AND len(a.w) = 0 AND len(b.w) = 0
), reach AS (
  SELECT t AS x, t AS y FROM texts UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x
), ids AS (
  SELECT t, min(doc_id) AS doc_id FROM base GROUP BY t
), class AS (
  SELECT x, min(doc_id) AS class_id FROM reach JOIN ids ON ids.t = reach.y GROUP BY x
), counted AS (
  SELECT x, count(*) AS n_links FROM link GROUP BY x
)
SELECT base.doc_id, class_id, coalesce(n_links, 0) AS n_links
FROM base JOIN class ON class.x = base.t LEFT JOIN counted ON counted.x = base.t
"""


@query("op3_near_duplicates", _OP3_SQL)
def op3_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    classes = near_duplicates.near_duplicates(as_pages(table(spark, folder, "documents")))
    return as_documents(classes).select("doc_id", "class_id", "n_links")


def held_out(doc_id: str = "doc_id"):
    """Rows that no label may be learned from: a fifth, by the id's checksum."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def documents_network(spark: SparkSession, folder: str) -> quality_model.Network:
    labels = table(spark, folder, "labels").filter(~held_out()).select(F.col("doc_id").alias("page_id"), "quality")
    return quality_model.fit_quality(as_pages(table(spark, folder, "documents")), labels)


@query("op4_quality_classifier")
def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    scored = quality_model.score_pages(as_pages(table(spark, folder, "documents")), documents_network(spark, folder))
    return as_documents(scored).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


_OP6_SENTENCE = "trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))"
_OP6_NAME = "CASE " + " ".join(
    f"WHEN regexp_matches(z, '\\b{p}\\b') THEN '{i}'" for i, p in license_scan.SENTENCES) + " ELSE 'unknown' END"


def _op6_sequence() -> str:
    sequence = "seq"
    for licence, pattern in license_scan.RULES:
        # the pattern starts after "," or ">", which the twin keeps as a group, as its engine can't look behind
        sequence = f"regexp_replace({sequence}, '([,>]){pattern}', '\\1<{licence}>', 'g')"
    return sequence


_OP6_SQL = rf"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), sentence AS (
  SELECT rid, i, parts[i] AS s FROM (
    SELECT rid, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
      SELECT rid, string_split(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '([.!?;:]) ', '\1' || chr(10), 'g'), chr(10)) AS parts
      FROM base))
), named AS (
  SELECT rid, i, {_OP6_NAME} AS name FROM (
    SELECT rid, i, {_OP6_SENTENCE} AS z FROM sentence WHERE regexp_matches(s, '(?i){license_scan.HINTS}'))
), sequences AS (
  SELECT rid, coalesce(',' || string_agg(name, ',' ORDER BY i) FILTER (WHERE name <> 'unknown') || ',', '') AS seq,
         count(*) FILTER (WHERE name <> 'unknown') AS n_known, count(*) FILTER (WHERE name = 'unknown') AS n_unknown
  FROM named GROUP BY rid
), found AS (
  SELECT rid, n_known, n_unknown, regexp_extract_all({_op6_sequence()}, '<([^>]*)>', 1) AS l FROM sequences
), once AS (
  SELECT rid, string_agg(x, ' ' ORDER BY nr) AS licenses FROM (
    SELECT rid, x, min(nr) AS nr FROM (SELECT rid, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS nr FROM found) GROUP BY rid, x) GROUP BY rid
)
SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(n_known, 0) AS n_known, coalesce(n_unknown, 0) AS n_unknown
FROM base LEFT JOIN found USING (rid) LEFT JOIN once USING (rid)
"""


@query("op6_license_scan", _OP6_SQL)
def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    scanned = license_scan.scan_licenses(as_pages(table(spark, folder, "documents")))
    return as_documents(scanned).select("doc_id", F.array_join("licenses", " ").alias("licenses"), "n_known", "n_unknown")


#: Domains of the given tables, which have none of their own: by the number in a source's name.
DOMAINS = ("web", "books", "forums")
MIX_LEVELS = ("domain", "lang", "source")
MIX_WEIGHTS = ({"web": 5, "books": 3, "forums": 2}, {"en": 4, "de": 2, "fr": 2, "es": 2}, {})
MIX_EPOCHS = 2


def with_domain(documents: DataFrame) -> DataFrame:
    number = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) AS bigint) % 3")
    domain = F.when(number == 0, DOMAINS[0]).when(number == 1, DOMAINS[1]).when(number == 2, DOMAINS[2])
    return documents.withColumns({"domain": domain, "n_words": mixing.word_count(F.col("text"))})


def mix_documents(documents: DataFrame) -> DataFrame:
    """As many words as there are, shared out anew by domain, language and source, in up to two epochs; with ``epoch``."""
    return mixing.mix_to_weights(
        with_domain(documents), MIX_LEVELS, MIX_WEIGHTS, ["doc_id"], "n_words", share=(1, 1), max_epochs=MIX_EPOCHS, seed=1)


def _op7_shared(level: str, parent: str, key: str, weight: str) -> str:
    """A level's budgets from those of the level above, as in ``mixing.share_out``."""
    by = f"PARTITION BY {parent}" if parent else ""
    ahead = f"OVER ({by} ORDER BY CAST(cap AS DOUBLE) / w NULLS FIRST, {key} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    columns = f"{parent}, {key}" if parent else key
    return f"""
{level}_a AS (
  SELECT *, coalesce(sum(w) {ahead}, 0) AS w_ahead, coalesce(sum(cap) {ahead}, 0) AS c_ahead, sum(w) OVER ({by}) AS w_all
  FROM (SELECT n.*, {weight} AS w FROM {level}_n n)
), {level}_b AS (
  SELECT *, cap * (w_all - w_ahead) <= (top - c_ahead) * w AS filled FROM {level}_a
), {level}_c AS (
  SELECT *, coalesce(sum(CASE WHEN filled THEN cap END) OVER ({by}), 0) AS c_full,
         w_all - coalesce(sum(CASE WHEN filled THEN w END) OVER ({by}), 0) AS w_open FROM {level}_b
), {level} AS (
  SELECT {columns}, CASE WHEN filled THEN cap ELSE ((top - c_full) * w) // nullif(w_open, 0) END AS budget FROM {level}_c
)"""


_OP7_SQL = rf"""
WITH d AS (
  SELECT doc_id, lang, source, CASE try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 3
           WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'forums' END AS domain,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), leaf AS (
  SELECT domain, lang, source, CAST(sum(size) AS HUGEINT) AS size FROM d GROUP BY ALL
), l1_n AS (
  SELECT domain, sum(size * 2) AS cap, (SELECT sum(size) FROM leaf) AS top FROM leaf GROUP BY ALL
), {_op7_shared("l1", "", "domain", "CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 WHEN 'forums' THEN 2 ELSE 1 END")}
, l2_n AS (
  SELECT domain, lang, sum(size * 2) AS cap, any_value(budget) AS top FROM leaf JOIN l1 USING (domain) GROUP BY ALL
), {_op7_shared("l2", "domain", "lang", "CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END")}
, l3_n AS (
  SELECT domain, lang, source, sum(size * 2) AS cap, any_value(budget) AS top FROM leaf JOIN l2 USING (domain, lang) GROUP BY ALL
), {_op7_shared("l3", "domain, lang", "source", "1")}
, plan AS (
  SELECT domain, lang, source, budget // size AS whole, budget % size AS rest FROM l3 JOIN leaf USING (domain, lang, source)
), drawn AS (
  SELECT d.*, whole, rest, md5('1|' || (whole + 1) || '|' || doc_id) AS draw FROM d JOIN plan USING (domain, lang, source)
), run AS (
  SELECT *, sum(size) OVER (PARTITION BY domain, lang, source ORDER BY draw) AS reached FROM drawn
), times AS (
  SELECT doc_id, domain, lang, source, size, whole + CASE WHEN rest > 0 AND reached - size < rest THEN 1 ELSE 0 END AS n FROM run
)
SELECT doc_id, domain, lang, source, CAST(size AS BIGINT) AS n_words, CAST(unnest(range(1, CAST(n AS BIGINT) + 1)) AS BIGINT) AS epoch FROM times
"""


@query("op7_mixing", _OP7_SQL)
def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix_documents(table(spark, folder, "documents")).select(
        "doc_id", *MIX_LEVELS, "n_words", F.col("epoch").cast("long").alias("epoch"))


@query("op5_byte_bpe")
def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    rules = BYTE_BPE, public_tokenizers.PATTERN
    coded = byte_bpe.round_trip_pages(as_pages(table(spark, folder, "documents")), *rules)
    return as_documents(coded).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op8_fingerprints")
def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    compared = fingerprints.compare_with_edits(as_pages(table(spark, folder, "documents")))
    return as_documents(compared).select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        "near_edited", "near_next")


_OP9_SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM base
), win AS (
  SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM split)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM win) WHERE n >= 2
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) o(k) GROUP BY rid
), m AS (
  SELECT rid, doc_id, len(words) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(lines) AS n_lines,
         length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS n_capitals,
         length(text) - length(replace(text, '!', '')) AS n_exclamations
  FROM split LEFT JOIN covered USING (rid)
), f AS (
  SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_capitals > 40 * word_chars THEN 64 ELSE 0 END
    + CASE WHEN 100 * n_exclamations > 20 * n_words THEN 128 ELSE 0 END AS failure_bits
  FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (failure_bits & 3) <> 0 AS base_failed, failure_bits = 0 AS kept, CAST(failure_bits AS BIGINT) AS failure_bits
FROM f
"""


@query("op9_quality_rules", _OP9_SQL)
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    ledger = quality_rules.rule_ledger(as_pages(table(spark, folder, "documents")))
    judged = quality_rules.apply_policy(ledger, quality_rules.POLICIES[2])
    base = quality_rules.policy_mask(quality_rules.POLICIES[1])
    return as_documents(judged).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failure_bits").bitwiseAND(F.lit(base)) != 0).alias("base_failed"), "kept", "failure_bits")


_ABLATIONS_SQL = _OP9_SQL.split("SELECT doc_id, CAST(n_words", 1)[0] + """, r AS (
  SELECT unnest(range(8)) AS bit, unnest(['few_words', 'repeated_words', 'symbols', 'repeated_lines', 'short_words', 'long_words',
                                          'capitals', 'exclamations']) AS rule
)
SELECT rule, count(*) FILTER (WHERE failure_bits & (1 << bit) <> 0) AS n_failed, count(*) FILTER (WHERE failure_bits = 1 << bit) AS n_failed_alone,
       count(*) FILTER (WHERE failure_bits = 0) AS n_kept, count(*) FILTER (WHERE failure_bits & ~(1 << bit) = 0) AS n_kept_without
FROM r, f GROUP BY rule
"""


@query("quality_rule_ablations", _ABLATIONS_SQL)
def quality_rule_ablations(spark: SparkSession, folder: str) -> DataFrame:
    """What each rule of the policy does to all documents, from the ledger's bit patterns."""
    ledger = quality_rules.rule_ledger(as_pages(table(spark, folder, "documents")))
    return quality_rules.ablations(ledger, quality_rules.POLICIES[2])


_OP10_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p
), r AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS response_id FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN response_id IS NULL OR page_id IS NOT DISTINCT FROM response_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN response_id IS NULL OR page_id IS NOT DISTINCT FROM response_id THEN NULL ELSE response_id END AS refers_to
FROM r
"""


@query("op10_warc", _OP10_SQL)
def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    archive = scratch_path(spark, "archive")
    warc.archive_pages(table(spark, folder, "pages"), archive)
    return warc.read_archive(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_RECORDS_SQL = _OP10_SQL.rsplit("SELECT page_id", 1)[0] + r"""
SELECT page_id, CAST(CASE WHEN response_id IS NULL OR page_id IS NOT DISTINCT FROM response_id THEN payload_bytes ELSE 0 END AS BIGINT) AS body_bytes,
       true AS sound FROM r
"""


@query("rebuilt_web_records", _RECORDS_SQL)
def rebuilt_web_records(spark: SparkSession, folder: str) -> DataFrame:
    """Each record put together by the join of heads and payloads: what its body holds, and whether its length is what its head says."""
    archive = scratch_path(spark, "archive")
    warc.archive_pages(table(spark, folder, "pages"), archive)
    lengths = warc.record_lengths(warc.read_archive(spark, archive))
    return lengths.select("page_id", "body_bytes", (F.col("record_bytes") == F.col("head_says")).alias("sound"))


_OP11_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_OP11_WORDS} AS w FROM documents
), item AS (
  SELECT item_id, w, least(len(w), 10) AS l FROM (SELECT item_id, {_OP11_WORDS} AS w FROM benchmark) WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, l, w[i:i + l - 1] AS words FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM item)
), place AS (
  SELECT rid, i, l, w[i:i + l - 1] AS words
  FROM (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM win) WHERE len(w) >= l)
), found AS (
  SELECT rid, i, l, item_id FROM place JOIN win USING (l, words)
), hit AS (
  SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + l)) AS at FROM found) GROUP BY rid
), named AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
"""


@query("op11_benchmark_leaks", _OP11_SQL)
def op11_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    leaks = benchmark_leaks.find_leaks(as_pages(table(spark, folder, "documents")), table(spark, folder, "benchmark"))
    return as_documents(leaks).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SLIP_EVERY = 31  # planted slips of the pen, by which the query's contract tests the grouping

_OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))
), run AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents) WHERE length(r) >= 7 GROUP BY ALL
), signed AS (
  SELECT r, n, xor(list_reduce(list_concat([4294967295], list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
                               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS s
  FROM (SELECT r, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r)) AS h FROM run), crc
), v AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN s % 31 = 0 THEN substr(r, 1, s % length(r)) || substr(r, s % length(r) + 2) ELSE r END AS word FROM signed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), less AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN v b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS most FROM near GROUP BY word
), judged AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * v.n THEN other END AS form, CASE WHEN most >= 10 * v.n THEN most END AS form_n
  FROM v LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root FROM judged
  UNION ALL SELECT walk.word, j.form FROM walk JOIN judged j ON j.word = walk.root WHERE j.form IS NOT NULL
)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM judged
JOIN (SELECT walk.word, root FROM walk JOIN judged j ON j.word = root WHERE j.form IS NULL) USING (word)
"""


@query("op12_spelling_variants", _OP12_SQL)
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    words = spelling.count_words(as_pages(table(spark, folder, "documents")), slip_every=SLIP_EVERY)
    return spelling.spelling_groups(write_scratch(words, "words"))


_OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN first_id IS NOT NULL AND (d.doc_id IS NULL OR d.doc_id > first_id) THEN 'E' ELSE '' END AS failed
  FROM d LEFT JOIN l USING (doc_id)
), p AS (
  SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), letter AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, k AS step, substr(filter_order, k, 1) AS x FROM o, (SELECT unnest(range(1, 6)) AS k)
), j AS (
  SELECT *, contains(failed, x) AS fails,
         coalesce((SELECT min(i) FROM (SELECT unnest(range(1, 6)) AS i) WHERE contains(failed, substr(filter_order, i, 1))), 6) AS goes
  FROM p, s
), r AS (
  SELECT part, filter_order, step, x, sum(CASE WHEN goes > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN goes = step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN fails AND goes < step THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = x THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN goes = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN goes = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM j GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM r
"""


@query("op13_filter_audit", _OP13_SQL)
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    pages = as_pages(table(spark, folder, "documents"), F.col("source").alias("site"))
    labels = table(spark, folder, "labels").withColumnRenamed("doc_id", "page_id")
    return filter_audit.audit_filters(pages, labels).withColumnRenamed("site", "part")
