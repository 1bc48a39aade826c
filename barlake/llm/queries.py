"""The operators as registered queries over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat,
    filter_audit,
    fingerprints,
    lm_scoring,
    mixing,
    ngram_join,
    packing,
    quality_classifier,
    quality_rules,
    suffix_dedup,
    token_counts,
    toxicity,
    vector_codes,
)
from .common import materialize, table, training_rows

#: The vocabulary of byte_bpe_50k.json as ranks: the same ids, in less time.
TOKENIZER = "byte_bpe_50k.tiktoken"


def tokenizer() -> tuple[str, str]:
    """Path of the vocabulary and its word pattern."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), *tokenizer())
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.drop("kept")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(training_rows("doc_id", 7) == 2, F.lit(True))
    model = lm_scoring.fit(docs.where(~held_out).select("text"))
    scored = lm_scoring.score(docs, model)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").union(extra)
    done = chat.format_branches(chat.chain_tree(rows))
    turns = chat.read_turns(F.col("formatted"))
    loss = chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    done = done.select(F.col("tree").alias("conv_id"), "formatted", turns.alias("turns"), loss.alias("loss"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.clean_lines(table(spark, sf_dir, "documents")).drop("cleaned")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.next_documents(table(spark, sf_dir, "documents"))
    n = F.length("text")
    part = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - part), F.substring("following", F.lit(1), part))
    rows = rows.withColumns({"edited": edited, "n_chars": n.cast("long")})
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    rows = fingerprints.compare_versions(rows, "text", {"edited": "edited", "next": "following"})
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        F.col("fingerprint_edited").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(training_rows("doc_id", 5) != 0))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", F.coalesce(training_rows("doc_id", 5) == 0, F.lit(True)).alias("held_out"), "score", "predicted")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    # read twice, to learn and to score
    docs = materialize(quality_classifier.with_features(table(spark, sf_dir, "documents"), ["doc_id"]), "features")
    ranking = quality_classifier.fit(docs, quality_classifier.label_split(table(spark, sf_dir, "labels")))
    scored = quality_classifier.score_quality(docs, ranking)
    return scored.select("doc_id", F.coalesce(training_rows("doc_id", 5) == 0, F.lit(True)).alias("held_out"), "score", "predicted")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def queries() -> dict:
    return {
        "op1_packing": op1_packing,
        "op2_ngram_join": op2_ngram_join,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_lm_scoring": op4_lm_scoring,
        "op5_chat_formatting": op5_chat_formatting,
        "op6_quality_rules": op6_quality_rules,
        "op7_fingerprints": op7_fingerprints,
        "op8_toxicity": op8_toxicity,
        "op9_mixing": op9_mixing,
        "op10_quality_classifier": op10_quality_classifier,
        "op11_filter_audit": op11_filter_audit,
        "op12_vector_codes": op12_vector_codes,
        "op13_token_counts": op13_token_counts,
    }


_OP5 = r"""
WITH c AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t.turn, t.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(8 + 8 + 4 + length(replace(replace(role, '<', '<' || chr(92)), '[', '[' || chr(92)))
    + length(replace(replace(text, '<', '<' || chr(92)), '[', '[' || chr(92)))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

_OP9 = r"""
WITH RECURSIVE sizes AS (
  SELECT coalesce(source, '') AS source, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS size FROM documents GROUP BY 1
), rates AS (
  SELECT source, CASE WHEN size > 0 THEN pow(CAST(size AS DOUBLE), 0.5) / (SELECT sum(pow(CAST(size AS DOUBLE), 0.5)) FROM sizes)
    * (SELECT sum(size) FROM sizes) / size ELSE 0 END AS rate FROM sizes
), steps AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS term, exp(-rate) AS cdf FROM rates
  UNION ALL SELECT source, rate, k + 1, term * rate / (k + 1), cdf + term * rate / (k + 1) FROM steps WHERE k < 60
), u AS (
  SELECT *, CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM documents
), n AS (
  SELECT u.doc_id, any_value(u.text) AS text, any_value(u.lang) AS lang, any_value(u.source) AS source, any_value(u.n_chars) AS n_chars, count(*) AS n
  FROM u JOIN steps s ON coalesce(u.source, '') = s.source AND u.u >= s.cdf GROUP BY u.doc_id
)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy, md5('mix:' || CAST(doc_id AS VARCHAR) || ':' || copy) AS shuffle_key
FROM n, unnest(generate_series(1, n)) g(copy)
"""


_OP6 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
g AS (
  SELECT doc_id, i, array_to_string(words[i:i+4], ' ') AS g FROM (
    SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w WHERE len(words) >= 5)
),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
cover AS (
  SELECT doc_id, CAST(sum(least(5, coalesce(nxt - i, 5))) AS BIGINT) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM hit) GROUP BY doc_id
),
l AS (
  SELECT doc_id, n, line, regexp_replace(line, '[\x20\x09-\x0D]', '', 'g') AS bare FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS n FROM d)
),
j AS (
  SELECT doc_id, line, bare, length(bare) AS chars,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
    length(bare) - length(regexp_replace(bare, '[#*$%&|<>]', '', 'g')) AS symbols,
    len(regexp_extract_all(line, '!!')) AS shouts,
    len(list_filter(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda w: w IN ('|', '›', '»', '•', '·'))) AS bars,
    len(list_filter(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda w: w LIKE 'http://%' OR w LIKE 'https://%' OR w LIKE 'www.%')) AS links,
    regexp_replace(line, '[\x20\x09-\x0D]+$', '') AS cut,
    row_number() OVER (PARTITION BY doc_id ORDER BY n) AS spot
  FROM l WHERE bare <> ''
),
s AS (SELECT *, length(cut) <= 30 AND NOT contains('.!?:;,…"''”»)]', right(cut, 1)) AS short FROM j),
m AS (
  SELECT *, sum(CAST(short AS INT)) OVER (PARTITION BY doc_id ORDER BY spot ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) = 3 AS run FROM s
),
v AS (
  SELECT *, (symbols * 100 > chars * 15) OR (shouts * 100 > words * 50) OR (bars >= 2 AND bars * 100 > words * 30) OR (links * 100 > words * 50)
    OR regexp_matches(cut, '(…|\.\.\.)$') OR bool_or(run) OVER (PARTITION BY doc_id ORDER BY spot ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
    OR regexp_matches(lower(line), 'javascript|cookie policy|privacy policy|terms of use|all rights reserved|lorem ipsum|powered by'
      || '|datenschutzerklärung|alle rechte vorbehalten|nutzungsbedingungen|tous droits réservés'
      || '|politique de confidentialité|mentions légales|todos los derechos reservados|política de privacidad') AS bad FROM m
),
a AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE bad) AS n_bad_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
    CAST(coalesce(sum(chars) FILTER (WHERE NOT bad), 0) AS BIGINT) AS left_chars FROM v GROUP BY doc_id
),
r AS (
  SELECT w.doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_bad_lines, 0) AS n_bad_lines, coalesce(left_chars, 0) AS left_chars
  FROM w LEFT JOIN cover USING (doc_id) LEFT JOIN a USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_bad_lines,
  n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed,
  NOT (n_words < 10 OR n_repeat_words * 100 > n_words * 20) AND (word_chars - left_chars) * 100 <= word_chars * 50 AS kept
FROM r
"""


_OP11 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), f AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
  FROM d
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT '' AS filter_order
  UNION ALL SELECT filter_order || x FROM o JOIN letters ON NOT contains(filter_order, x)
), s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS own, '[' || substr('-' || filter_order, 1, step) || ']' AS before
  FROM o, generate_series(1, 5) g(step) WHERE length(filter_order) = 5
), r AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (WHERE NOT contains(fails, own) AND NOT regexp_matches(fails, before)), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE contains(fails, own) AND NOT regexp_matches(fails, before)), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE contains(fails, own) AND regexp_matches(fails, before)), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE fails = own), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE contains(fails, own) AND NOT regexp_matches(fails, before)), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE contains(fails, own) AND NOT regexp_matches(fails, before)), 0) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""


def _op12() -> str:
    """The rounds as plain assignments to all entries."""
    ctes = [
        """
kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * 256) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), cells AS (
  SELECT vec_id, CAST((i - 1) // (n // 16) AS BIGINT) AS part, CAST((i - 1) % (n // 16) AS BIGINT) AS place, v
  FROM (SELECT vec_id, len(x) AS n, unnest(x) AS v, unnest(generate_series(1, len(x))) AS i FROM kept)
), c0 AS (
  SELECT part, entry, place, v FROM cells
  JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64) USING (vec_id)
)"""
    ]
    for k in range(vector_codes.ROUNDS + 1):
        ctes.append(f"""
d{k} AS (
  SELECT vec_id, part, entry, sum((a.v - b.v) * (a.v - b.v)) AS d
  FROM cells a JOIN c{k} b USING (part, place) GROUP BY vec_id, part, entry
), a{k} AS (
  SELECT vec_id, part, entry, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1
)""")
        if k < vector_codes.ROUNDS:
            ctes.append(f"""
m{k} AS (
  SELECT part, entry, place, sum(v) AS s, count(*) AS n FROM cells JOIN a{k} USING (vec_id, part) GROUP BY part, entry, place
), c{k + 1} AS (
  SELECT part, entry, place, coalesce(CAST((s - ((s % n) + n) % n) // n AS BIGINT), c.v) AS v FROM c{k} c LEFT JOIN m{k} USING (part, entry, place)
)""")
    last = vector_codes.ROUNDS
    return f"""
WITH {",".join(ctes)},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, place)) FROM c{last}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_chat_formatting": _OP5,
        "op6_quality_rules": _OP6,
        "op9_mixing": _OP9,
        "op11_filter_audit": _OP11,
        "op12_vector_codes": _op12(),
    }
