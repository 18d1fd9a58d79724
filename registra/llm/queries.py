"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registra.llm import chat, collocations, decontam, language, merkle, mixing, packing, quality, simhash, substrings, tokens, toxicity, urls
from registra.llm.words import small_batches

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str) -> Column:
    """The part a document belongs to; part 2 is never learned from. Null keys are in none."""
    return F.crc32(F.col(key).cast("string")) % 4


def held_out(key: str) -> Column:
    return F.coalesce(remainder(key) == 2, F.lit(False)).alias("held_out")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each text, the base rule and the verdict of the threshold table."""
    rows = quality.measures(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.col(f"__m.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    failed = (F.col("__m.n_words") < 10) | (100 * F.col("__m.n_repeat_words") > 20 * F.col("__m.n_words"))
    return rows.select("doc_id", *counts, failed.alias("base_failed"), (~failed & quality.verdict()).alias("kept"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = toxicity.scored(docs, table(spark, sf_dir, "labels"), remainder("__id") != 2)
    return rows.select(
        "doc_id", held_out("doc_id"), F.col("__score").alias("score"), (F.col("__score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = mixing.mix(docs.select(F.col("doc_id").alias("id"), mixing.word_count("text").alias("size"), "source"))
    return rows.withColumnRenamed("id", "doc_id")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "__cut.n_words", "__cut.n_removed", F.sha2("__cut.kept", 256).alias("kept_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = language.identified(docs, remainder("__id") != 2)
    return rows.select("doc_id", held_out("doc_id"), F.col("__lang.pred").alias("lang_pred"), F.col("__lang.score").alias("score"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


URL_RULES = (
    urls.UrlRule("net", "/", "block"),
    urls.UrlRule("example.net", "/en/", "allow"),
    urls.UrlRule("example.com", "/de/", "block"),
    urls.UrlRule("org", "/fr/", "allow"),
)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return rows.select("page_id", "__url.host", "__url.path", "__url.rule", "__url.verdict")


def transcripts(conversations: DataFrame) -> DataFrame:
    """Conversations as plain transcripts: speaker markers of a style that goes by the conversation.

    One turn in ten, but never the first, lost its marker, as in scraped text.
    """
    styles = (
        ("System: ", "User: ", "Assistant: "), ("Instructions: ", "Human: ", "AI: "),
        ("### System:\n", "### User:\n", "### Assistant:\n"), ("**Context:** ", "**Q:** ", "**A:** "),
    )
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(styles)))
    mark = F.lit("")
    for i, names in enumerate(styles):
        for role, name in zip(chat.ROLES, names):
            mark = F.when((style == i) & (F.col("role") == role), name).otherwise(mark)
    lost = (F.col("turn") > 0) & (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(10)) == 0)
    return conversations.select(
        "conv_id", "turn", F.col("role").alias("given"),
        F.concat(F.when(lost, "").otherwise(mark), F.coalesce("text", F.lit(""))).alias("text"),
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical turns of all conversations, recovered from their transcripts without the given roles."""
    return chat.parse(transcripts(table(spark, sf_dir, "conversations")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, with the item and how much of it they cover."""
    return decontam.contaminated(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    ).drop("tk")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language by how much more often they occur than their parts would have it."""
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and proofs of all documents, and what a tampered copy of a part of them folds to."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0

    def leaf(text: Column) -> Column:
        return merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)

    original = leaf(F.col("text"))
    seen = F.when(tampered, leaf(F.translate("text", "\n", ""))).otherwise(original)
    rows = merkle.manifest(docs, "doc_id", "source", original, seen)
    return rows.withColumn("folded", merkle.folded_root(F.col("carried"), F.col("path"))).select(
        "doc_id", *[F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")], merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        F.lower(F.hex("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


def op13_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the pieces of all documents stand in sequences of 1024 tokens."""
    rows = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), value=F.crc32("ids"))
    return rows.select("doc_id", "start", "length", F.col("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_toxicity, op3_source_mix, op4_substring_dedup, op5_language_id,
        op6_token_counts, op7_simhash_near_dedup, op8_url_filter, op9_chat_format, op10_decontamination,
        op11_collocations, op12_merkle_manifest, op13_harmonic_packing,
    )
} | {"pipeline": _pipeline}


def _strings(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_STOPS = _strings(dict.fromkeys(w for s in quality.STOP_WORDS for w in (s, s.capitalize())))
_RULES_SQL = " AND ".join(
    f"{r.measure} {op} {limit}" for r in quality.RULES for op, limit in ((">=", r.least), ("<=", r.most)) if limit is not None
)
_TERM = "[^a-z0-9]"


def _found(term: str) -> str:
    return f"regexp_matches(u, '(^|{_TERM}){term}($|{_TERM})')"


ORACLES: dict[str, str] = {
    "op1_quality_rules": rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n >= 2),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(0, 5)) AS j) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(r.n, 0) AS n_repeat_words, len(list_intersect(w, {_STOPS})) AS n_stop_words,
         len(regexp_extract_all(t, '!')) AS n_exclamations, len(l) AS n_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•]\s'))) AS n_bullets,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipses
  FROM d LEFT JOIN r USING (doc_id)),
q AS (
  SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_length, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbol_ratio,
         coalesce(n_exclamations / nullif(n_words, 0), 0) AS exclamation_ratio, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS duplicate_line_ratio,
         coalesce(n_bullets / nullif(n_lines, 0), 0) AS bullet_line_ratio, coalesce(n_ellipses / nullif(n_lines, 0), 0) AS ellipsis_line_ratio,
         coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_word_ratio,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND {_RULES_SQL} AS kept
FROM q""",
    "op4_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, sha256(array_to_string(list_slice(w, i, i + 49), ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM s), (SELECT unnest(range(0, 50)) AS j) WHERE doc_id > first),
words AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) FILTER (gone.p IS NULL) AS t, count(gone.p) AS n
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op8_url_filter": rf"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path, translate(coalesce(url, ''), '{urls.UPPER}', '{urls.LOWER}') AS u
  FROM pages),
r AS (
  SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
         {" OR ".join(_found(t) for t in urls.STRICT)} AS strict,
         {" + ".join(f"CAST({_found(t)} AS INTEGER)" for t in urls.SOFT)} AS soft
  FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN strict OR soft >= 2 THEN 'block' ELSE 'allow' END AS verdict
FROM r""",
    "op11_collocations": rf"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, phrase, k, count(*) AS f
  FROM (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k)))
  GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (
  SELECT c.lang, c.phrase, a, cut, l.f AS l, r.f AS r, n, (CAST(1000 AS HUGEINT) * a * n) // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) AS c JOIN totals USING (lang)
  JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(w, 1, cut), ' ')
  JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(w, cut + 1, c.k), ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_parts AS (
  SELECT DISTINCT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, a
  FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c))),
held AS (SELECT lang, phrase, max(a) AS most FROM inner_parts GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN held USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000""",
    "op12_merkle_manifest": r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
d AS (
  SELECT *, doc_id IS NOT NULL AND xor(list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 2 = 0 AS tampered
  FROM documents, crc),
f AS (
  SELECT doc_id, source, tampered, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS body, coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-') AS cut
  FROM d),
leaves AS (
  SELECT doc_id, source, sha256(head || body) AS h, sha256(head || CASE WHEN tampered THEN cut ELSE body END) AS seen,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, sha256(head || body)) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
  FROM f),
nodes AS (
  SELECT source, 0 AS level, idx, n, h FROM leaves
  UNION ALL
  SELECT source, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY source, level, idx // 3, n),
tops AS (
  SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS level, idx, n, h FROM tops
  UNION ALL
  SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM upper WHERE n > 1 GROUP BY level, idx // 3, n),
steps AS (
  SELECT a.source, 0 AS tree, a.level, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM nodes a JOIN nodes b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.idx // 3 = b.idx // 3 AND a.n > 1
  GROUP BY a.source, a.level, a.idx
  UNION ALL
  SELECT NULL, 1, a.level, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), ''),
         coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '')
  FROM upper a JOIN upper b ON a.level = b.level AND a.idx // 3 = b.idx // 3 AND a.n > 1 GROUP BY a.level, a.idx),
path AS (
  SELECT v.source, v.idx, 0 AS tree, s.level, s.l, s.r
  FROM leaves v JOIN steps s ON s.tree = 0 AND v.source IS NOT DISTINCT FROM s.source AND s.idx = v.idx // CAST(power(3, s.level) AS BIGINT)
  UNION ALL
  SELECT v.source, v.idx, 1, s.level, s.l, s.r
  FROM leaves v JOIN tops t ON v.source IS NOT DISTINCT FROM t.source JOIN steps s ON s.tree = 1 AND s.idx = t.idx // CAST(power(3, s.level) AS BIGINT)),
paths AS (
  SELECT source, idx, list({'l': l, 'r': r} ORDER BY tree, level) AS p, string_agg(l || r, '' ORDER BY tree, level) AS proof FROM path GROUP BY source, idx),
folded AS (
  SELECT v.doc_id, v.source, v.h, 1 AS k, v.seen AS x, coalesce(p, []) AS p, coalesce(proof, '') AS proof
  FROM leaves v LEFT JOIN paths ON v.source IS NOT DISTINCT FROM paths.source AND v.idx = paths.idx
  UNION ALL
  SELECT doc_id, source, h, k + 1, sha256(p[k].l || x || p[k].r), p, proof FROM folded WHERE k <= len(p)),
whole AS (SELECT h AS root FROM upper WHERE n = 1)
SELECT doc_id, folded.h AS leaf, tops.h AS subroot, root, sha256(proof) AS proof_sha256, x AS folded_root, x = root AS verified
FROM folded JOIN tops ON folded.source IS NOT DISTINCT FROM tops.source, whole WHERE k = len(p) + 1""",
}
