"""One query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import (
    decontamination, licenses, neardup, packing, periodic, quality, scoring,
    substrings, suffixdedup, tokenfiles, urls, warc, whitening,
)
from ledgerlens.llm.registry import ORACLE, QUERIES, query, table  # noqa: F401
from ledgerlens.llm.tokens import word_tokenizer_path
from ledgerlens.session import scratch_path


@query("op10_benchmark_decontamination")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs, benchmark = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    found = decontamination.find_contamination(docs, benchmark, into="c", keep=["doc_id"])
    return found.select(
        "doc_id", "c.n_words", "c.n_hit", F.size("c.items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "c.items"), 256).alias("items_sha256"),
        decontamination.contaminated("c").alias("contaminated"),
        "c.spans")


@query("op9_quality_rules")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(table(spark, folder, "documents"), into="q", keep=["doc_id"])
    return judged.select("doc_id", *[f"q.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "class_distance", "word_distance")])


@query("op5_warc_salvage")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    archives = warc.write_archives(table(spark, folder, "pages"), scratch_path(spark, "warc"))
    records = warc.read_archives(spark, archives).filter("quarantined IS NULL")
    return records.select(
        F.expr("nullif(headers['x-row-key'], '')").cast("bigint").alias("page_id"),
        F.expr("try_element_at(headers, 'x-payload-length')").cast("bigint").alias("payload_bytes"),
        F.expr("substring(headers['warc-payload-digest'], 6)").alias("payload_digest"),
        F.expr("headers['warc-type']").alias("record_type"),
        F.expr("try_element_at(headers, 'x-refers-to-key')").cast("bigint").alias("refers_to"))


@query("op6_mixture_packing")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), word_tokenizer_path())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset")


@query("op1_lm_scoring")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 10 == 0
    docs = table(spark, folder, "documents")
    scored = scoring.score(docs, ~held_out, into="m", keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "m.*")


@query("op7_minhash_near_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.find_groups(table(spark, folder, "documents"), shingle_words=2)


@query("op2_substring_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    cut = substrings.remove_repeats(table(spark, folder, "documents"), into="d", keep=["doc_id"])
    kept = F.filter(F.split("d.text", r"[ \t-\r]+"), lambda w: w != "")
    return cut.select("doc_id", "d.n_words", "d.n_removed", F.sha2(
        F.concat_ws(" ", kept), 256).alias("kept_sha256"), "d.spans")


# A list of dated entries for the pages' hosts and their parent domains, by digits of their MD5.
_DIGIT = "ascii(substring(md5(p), {}, 1))"
_ADDED = f"(7 * {_DIGIT.format(1)} + 13 * {_DIGIT.format(2)} + {_DIGIT.format(3)}) % 365"
LIST_RULES = [
    ("block", "add", _ADDED, f"{_DIGIT.format(4)} % 3 = 0"),
    ("block", "remove", f"{_ADDED} + 20 + {_DIGIT.format(5)}", f"{_DIGIT.format(6)} % 2 = 0"),
    ("block", "add", f"{_ADDED} + 150 + {_DIGIT.format(7)}", f"{_DIGIT.format(8)} % 4 = 0"),
    ("allow", "add", f"{_ADDED} + {_DIGIT.format(9)}", f"{_DIGIT.format(10)} % 4 = 0"),
]
_FETCHED = "(page_id * 7919) % 365"
_HOST_SQL = """nullif(lower(regexp_extract(url,
    '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '')"""
_OP3_SQL = f"""
WITH captures AS (
    SELECT page_id, {_HOST_SQL} AS host, DATE '2024-01-01' + CAST({_FETCHED} AS INT) AS day
    FROM pages),
named AS (
    SELECT DISTINCT p FROM (
        SELECT host AS p FROM captures
        UNION ALL SELECT regexp_replace(host, '^[^.]*[.]', '') FROM captures) x
    WHERE p IS NOT NULL),
entries AS ({" UNION ALL ".join(
    f"SELECT p AS pattern, '{kind}' AS list, '{action}' AS action,"
    f" DATE '2024-01-01' + CAST({day} AS INT) AS day FROM named WHERE {where}"
    for kind, action, day, where in LIST_RULES)}),
spans AS (
    SELECT pattern, list, action, day AS since,
        coalesce(lead(day) OVER (PARTITION BY pattern, list ORDER BY day), DATE '9999-12-31') AS until
    FROM (SELECT pattern, list, day, max(action) AS action FROM entries GROUP BY ALL) d),
active AS (
    SELECT c.page_id, s.pattern, s.list, row_number() OVER (PARTITION BY c.page_id ORDER BY
        length(s.pattern) - length(replace(s.pattern, '.', '')) DESC, s.list) AS nth,
        count(*) OVER (PARTITION BY c.page_id) AS n
    FROM captures c JOIN spans s ON s.action = 'add' AND s.since <= c.day AND c.day < s.until
        AND (c.host = s.pattern OR suffix(c.host, '.' || s.pattern)))
SELECT c.page_id, c.host, CAST(c.day AS VARCHAR) AS day, coalesce(a.n, 0) AS n_active, a.pattern,
    a.list, coalesce(a.list = 'allow', true) AS kept
FROM captures c LEFT JOIN active a ON a.page_id = c.page_id AND a.nth = 1"""


@query("op3_url_filters", _OP3_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), F.expr(n).cast("int"))
    pages = table(spark, folder, "pages").select("page_id", "url", day(_FETCHED).alias("day"))
    host = urls.host_of(F.col("url"))
    parent = F.regexp_replace(host, "^[^.]*[.]", "")
    named = pages.select(F.explode(F.array(host, parent)).alias("p")).dropna().distinct()
    entries = named.select("p", F.explode(F.array(*[
        F.when(F.expr(where), F.struct(
            F.lit(kind).alias("list"), F.lit(action).alias("action"), day(n).alias("day")))
        for kind, action, n, where in LIST_RULES])).alias("e"))
    entries = entries.filter("e IS NOT NULL").select(F.col("p").alias("pattern"), "e.*")
    judged = urls.judge(pages, entries, into="u", keep=["page_id", "day"])
    return judged.select("page_id", "u.host", F.col("day").cast("string").alias("day"),
                         "u.n_active", "u.pattern", "u.list", "u.kept")


@query("op4_license_scan")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    scanned = licenses.scan(table(spark, folder, "documents"), into="l", keep=["doc_id"])
    return scanned.select(
        "doc_id", "l.n_words", F.size("l.found").cast("long").alias("n_licenses"),
        F.array_join("l.found.name", ",").alias("licenses"),
        F.coalesce(F.array_max("l.found.containment"), F.lit(0)).alias("containment"))


@query("op8_token_counts")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    written = tokenfiles.write_token_files(
        docs, scratch_path(spark, "tokens"), word_tokenizer_path())
    counted = tokenfiles.count_tokens(spark, written)
    # The names compress so well that the list looks small enough to broadcast; it is not.
    return counted.join(written.hint("merge"), ["path", "ordinal"]).select(
        F.col("id").alias("doc_id"), "n_tokens", "start", "ordinal")


@query("op11_suffix_array_dedup")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    cut = suffixdedup.remove_earlier_bytes(
        table(spark, folder, "documents"), into="d", keep=["doc_id"])
    return cut.select("doc_id", "d.n_bytes", "d.n_removed", "d.n_spans",
                      F.sha2("d.kept", 256).alias("kept_sha256"))


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents of ids with crc32 % 10 = 0 go on, from some word, with a repeated unit."""
    words = F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    planted = docs.withColumn("__h", h).withColumn("__g", F.floor(F.col("__h") / 10))
    planted = planted.withColumn("__w", F.when(F.col("__h") % 10 == 0, words))
    planted = planted.withColumn("__n", F.expr("nullif(size(__w), 0)"))
    planted = planted.withColumn("__a", F.expr("__g % __n"))
    planted = planted.withColumn("__p", F.expr("1 + (__n - __a) div (3 + __g % 8)"))
    line = F.expr("""array_join(transform(sequence(0, __n - 1), i -> element_at(__w, cast(
        1 + if(i < __a, i, __a + (i - __a) % __p) AS int))), ' ')""")
    return planted.select("doc_id", F.when(F.col("__n").isNotNull(), line).otherwise(
        F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs = _with_planted_runs(table(spark, folder, "documents"))
    found = periodic.find_runs(docs, into="p", keep=["doc_id"])
    # By exact length over period, falling; then by start and period.
    best = F.expr("""try_element_at(array_sort(p.runs, (a, b) -> CASE
        WHEN a.length * b.period > b.length * a.period THEN -1
        WHEN a.length * b.period < b.length * a.period THEN 1
        WHEN a.start < b.start THEN -1 WHEN a.start > b.start THEN 1
        WHEN a.period < b.period THEN -1 WHEN a.period > b.period THEN 1 ELSE 0 END), 1)""")
    lines = F.expr("concat_ws('', transform(p.runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    return found.withColumn("b", best).select(
        "doc_id", F.size("p.runs").cast("long").alias("n_runs"), "b.start", "b.length", "b.period",
        F.expr("1000 * b.length div b.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2(F.coalesce("p.text", F.lit("")), 256).alias("collapsed_sha256"))


@query("op13_embedding_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    white = whitening.whiten(table(spark, folder, "embeddings"), into="w", keep=["vec_id"])
    each = white.select("vec_id", "w.n", F.col("w.deviation").try_cast("long").alias("deviation"),
                        "w.explained", "w.identity_error", F.posexplode("w.whitened").alias("k", "whitened"))
    return each.select(
        "vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "whitened",
        F.expr("explained[k]").alias("explained"), "identity_error")
