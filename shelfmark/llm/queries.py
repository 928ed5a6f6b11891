"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import (
    bpe,
    chat,
    classifier,
    decontamination,
    fill_middle,
    mixing,
    pii,
    quality_rules,
    secret_scan,
    simhash,
    substrings,
    token_alignment,
    token_counts,
)
from shelfmark.llm.common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, line labels and verdict of every document."""
    documents = table(spark, sf_dir, "documents")
    model = quality_rules.fitted(documents, table(spark, sf_dir, "labels"))
    return documents.select("doc_id", quality_rules.judged(F.col("text"), model).alias("rules")).select("doc_id", "rules.*")


def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digests of the ids and of the decoded text of every document."""
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", bpe.encoded(F.col("text")).alias("bpe")).select(
        "doc_id",
        (F.octet_length("bpe.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("bpe.ids", 256).alias("ids_sha256"),
        F.sha2(F.col("bpe.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words inside repeated windows of every document, and a digest of the others."""
    repeats = substrings.Repeats(table(spark, sf_dir, "documents"), "doc_id")
    found = repeats.passages.select("key", "digest", "found.n_removed", F.col("found.sha256").alias("kept"))
    return repeats.rows.join(found, ["key", "digest"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept", "sha256").alias("kept_sha256"),
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    documents = table(spark, sf_dir, "documents")
    found = pii.with_spans(documents.select("doc_id", "text"), pii.fitted(documents), "found")
    return found.select(
        "doc_id",
        *[pii.of_kind(F.col("found.base"), kind).alias(f"n_{kind}") for kind in pii.BASE],
        F.sha2(pii.listed(F.col("found.base")), 256).alias("base_sha256"),
        pii.listed(F.col("found.spans")).alias("spans"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of a unigram vocabulary in every document."""
    return table(spark, sf_dir, "documents").select("doc_id", token_counts.counted(F.col("text")).alias("n_tokens"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that a document is good, for every document."""
    documents = table(spark, sf_dir, "documents")
    scores = classifier.scored(documents.select("doc_id", "text"), classifier.fitted(documents), "score")
    return scores.select("doc_id", "score", (F.col("score") >= 0.5).alias("kept"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items of benchmark passages in every document."""
    found = decontamination.with_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "found")
    items = F.array_sort(F.array_distinct("found.items"))
    n_hit = decontamination.n_hit(F.col("found.matches"))
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("found.matches") > 0).alias("contaminated"),
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    found = table(spark, sf_dir, "documents").select("doc_id", secret_scan.scanned(F.col("text")).alias("found"))
    return found.select(
        "doc_id",
        *[secret_scan.of_kind(F.col("found.base"), kind).alias(f"n_{kind}") for kind in secret_scan.KINDS[:3]],
        F.sha2(secret_scan.listed(F.col("found.base")), 256).alias("base_sha256"),
        secret_scan.listed(F.col("found.spans")).alias("spans"),
    )


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the formatted conversations say, read back; -1 says the control strings themselves."""
    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.formatted(turns))


def op11_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, with its source's size and target."""
    mix = mixing.Mix(table(spark, sf_dir, "documents"), "doc_id")
    sources = mix.sources.select("rank", F.col("size").alias("source_size"), "target")
    return mix.taken.join(sources, "rank").select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts of every document, with digests of the output and of the text rebuilt from it."""
    key = F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    cut = table(spark, sf_dir, "documents").select("doc_id", fill_middle.transformed(F.col("text"), key).alias("cut"))
    return cut.select(
        "doc_id",
        *[F.col(f"cut.{name}").alias(name) for name in ("n", "form", "prefix_chars", "middle_chars")],
        F.sha2(F.col("cut.output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("cut.output"), F.col("cut.form")).cast("binary"), 256).alias("restored_sha256"),
    )


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers in every document."""
    aligned = token_alignment.Alignment(table(spark, sf_dir, "documents"), "doc_id")
    return aligned.documents.withColumnRenamed("id", "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_quality_rules,
        op3_bpe_encode_decode,
        op4_substring_dedup,
        op5_pii,
        op6_token_counts,
        op7_quality_classifier,
        op8_benchmark_decontamination,
        op9_secret_scan,
        op10_chat_formatting,
        op11_mixing_sources,
        op12_fill_in_middle,
        op13_token_alignment,
    )
}

SQL: dict[str, str] = {}

# Words, windows of 35 and the words that windows found twice cover.
SQL["op4_substring_dedup"] = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), starts AS (
  SELECT r, unnest(range(1, len(ws) - 33)) AS s, ws FROM split WHERE len(ws) >= 35
), windows AS (
  SELECT r, s, md5(array_to_string(ws[s:s + 34], ' ')) AS h FROM starts
), twice AS (
  SELECT h FROM windows GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT r, unnest(range(s, s + 35)) AS p FROM windows SEMI JOIN twice USING (h)
), removed AS (
  SELECT r, list(p) AS ps FROM gone GROUP BY r
), kept AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed,
         list_filter(ws, lambda w, i: NOT list_contains(coalesce(ps, []), i)) AS k
  FROM split LEFT JOIN removed USING (r)
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""

# Windows of ten words of the items, sought in the documents by equality.
SQL["op8_benchmark_decontamination"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), sizes AS (
  SELECT DISTINCT least(10, len(ws)) AS n FROM items WHERE len(ws) > 0
), wanted AS (
  SELECT DISTINCT item, least(10, len(ws)) AS n, array_to_string(ws[s:s + least(10, len(ws)) - 1], ' ') AS w
  FROM (SELECT item, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS s FROM items WHERE len(ws) > 0)
), have AS (
  SELECT r, s, n, array_to_string(ws[s:s + n - 1], ' ') AS w
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM docs, sizes WHERE len(ws) >= n)
), hits AS (
  SELECT r, s, n, item FROM have JOIN wanted USING (n, w)
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r
), named AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN named USING (r)
"""

# The texts themselves, and the lengths that marks and escapes add.
SQL["op10_chat_formatting"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) AS x(t)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>') + length('<|im_end|>') + 2
           + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g'))
           + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS BIGINT) AS formatted_chars,
       CAST(0 AS BIGINT) AS taken_back
FROM turns GROUP BY conv_id
"""

# Units by regular expression, cuts from the digest of the id.
SQL["op12_fill_in_middle"] = r"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS us,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), drawn AS (
  SELECT doc_id, text, us, len(us) AS n,
         CAST('0x' || h[1:8] AS BIGINT) % (len(us) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (len(us) + 1) AS c2,
         CAST('0x' || h[17:24] AS BIGINT) % 100 AS plain_draw, CAST('0x' || h[25:32] AS BIGINT) % 100 AS spm_draw
  FROM split
), cut AS (
  SELECT doc_id, text, n,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR plain_draw >= 90 THEN 'plain'
              WHEN spm_draw < 20 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(us[1:least(c1, c2)], '') AS p,
         array_to_string(us[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
         array_to_string(us[greatest(c1, c2) + 1:], '') AS s
  FROM drawn
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""
