"""Queries of this package for ``__spark_entry__``: one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.session import read_table as table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

END_ID = 2


def vocabulary() -> str:
    """The public word-level vocabulary file, as text."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def vocabulary_pair() -> tuple[str, bytes]:
    """The public byte-level vocabulary as text and the public piece model."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, \
            open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return a.read(), b.read()


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op2_token_files(spark: SparkSession, sf: str) -> DataFrame:
    from quarry.llm import token_files as T

    return T.read_digests(T.write_files(table(spark, sf, "documents"), vocabulary(), END_ID))


@query
def op9_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    from quarry.llm import jaccard_join as J

    return J.component_ids(J.join(table(spark, sf, "documents"))[0])


@query
def op4_language_crf(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quarry.llm import language_crf as L

    docs = table(spark, sf, "documents")
    out = L.predict(docs, L.train(docs), keep=["doc_id"])
    doc = F.col("row.doc_id")
    return out.select(doc.alias("doc_id"), L.held_out(doc).alias("held_out"), "lang_pred", "score", "n_words",
                      F.greatest(F.size("runs") - 1, F.lit(0)).cast("long").alias("n_switches"))


@query
def op5_fm_index(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quarry.llm import decontaminate as D

    out = D.scan(table(spark, sf, "documents"), table(spark, sf, "benchmark"), keep=["doc_id"])
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


def _word_list(column: str, word: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{_UPPER}', '{_UPPER.lower()}'), '{word}')"


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE["op5_fm_index"] = f"""
WITH d AS (SELECT doc_id, {_word_list('text', _ALNUM_WORD)} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_word_list('text', _ALNUM_WORD)} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[k:k + 9], ' ') AS phrase
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, k, size, array_to_string(w[k:k + size - 1], ' ') AS phrase
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, k, dw.size, item FROM dw JOIN iw ON dw.phrase = iw.phrase AND dw.size = iw.size),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN found USING (doc_id)"""


@query
def op1_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    from quarry.llm import mixing as M
    from quarry.session import materialize

    rows = materialize(M.sized(table(spark, sf, "documents"), ["doc_id"]), "sized")
    return M.mix(rows, M.targets(rows)).select("row.doc_id", "size", "source_size", "target", "taken")


ORACLE["op1_mix_sources"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, sum(size) AS source_size, 3 * sum(size) AS cap,
             [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
level(n, l) AS (
  SELECT 0, CAST(0 AS DOUBLE)
  UNION ALL
  SELECT n + 1, (CAST(sum(source_size) AS DOUBLE) - coalesce(sum(CASE WHEN cap < l * w THEN cap END), 0))
                / sum(CASE WHEN NOT cap < l * w THEN w END)
  FROM level, s WHERE n < 30 GROUP BY n, l),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), w * (SELECT l FROM level WHERE n = 30)) AS target FROM s),
r AS (SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
             CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * least(3, whole + CASE WHEN 2 * before + size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END)
            AS BIGINT) AS taken
FROM r"""


@query
def op7_collision_search(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quarry.llm import collision_search as C

    return C.search(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op6_arc_to_warc(spark: SparkSession, sf: str) -> DataFrame:
    from quarry.llm import archives as A

    return A.pages_through_archives(table(spark, sf, "pages"))


ORACLE["op6_arc_to_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
q AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM q)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN top END AS refers_to
FROM r"""


@query
def op8_token_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document is inserted with an estimate, revised to its exact word
    count, inserted for a second tokenizer version, and deleted again when it
    has fewer than five words; two batches are delivered twice."""
    import uuid

    from pyspark.sql import functions as F

    from quarry.llm import token_rollup as T
    from quarry.session import _app_folder, ensure_checkpoint_dir, materialize

    d = table(spark, sf, "documents")
    d = materialize(d.select("source", "lang", F.floor(F.coalesce("n_chars", F.lit(0)) / 6).alias("guess"),
                             T.count_by_rule("text", "words-1").alias("w"), T.count_by_rule("text", "pieces-2").alias("p")),
                    "counted")

    def change(op: str, version: str, n: str, old: str | None = None):
        return ["source", "lang", F.lit(version).alias("tokenizer"), F.lit(op).alias("op"), F.col(n).alias("n_tokens"),
                (F.col(old) if old else F.lit(0).cast("long")).alias("old_tokens")]

    roll = T.Rollup(spark, f"{_app_folder(spark, ensure_checkpoint_dir(spark).rstrip('/'))}/rollup-{uuid.uuid4().hex}")
    short = d.where("w < 5")
    batches = {"insert": d.select(*change("insert", "words-1", "guess")),
               "revise": d.select(*change("revise", "words-1", "w", "guess")),
               "second": d.select(*change("insert", "pieces-2", "p")),
               "delete": short.select(*change("delete", "words-1", "w")).union(short.select(*change("delete", "pieces-2", "p")))}
    for name in ("insert", "revise", "revise", "second", "delete", "insert"):
        roll.commit(name, batches[name])
    return roll.levels()


ORACLE["op8_token_rollup"] = r"""
WITH d AS (SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w,
                  len(regexp_extract_all(coalesce(text, ''),
                      '[A-Za-z]+|[0-9]|[^\x00-\x7F]+|[^A-Za-z0-9\x{80}-\x{10FFFF}\x20\x09-\x0D]')) AS p FROM documents),
k AS (SELECT source, lang, 'words-1' AS tokenizer, w AS n FROM d WHERE w >= 5
      UNION ALL SELECT source, lang, 'pieces-2', p FROM d WHERE w >= 5)
SELECT source, lang, tokenizer, CAST(GROUPING(source, lang, tokenizer) AS INTEGER) AS level,
       CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens
FROM k GROUP BY GROUPING SETS ((source, lang, tokenizer), (source, tokenizer), (tokenizer))"""


@query
def op10_line_templates(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quarry.llm import line_templates as L

    out = L.drop_recurring(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.md5(F.coalesce("clean_text", F.lit(""))).alias("clean_md5"))


ORACLE["op10_line_templates"] = r"""
WITH RECURSIVE raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM raw),
toks AS (SELECT doc_id, pos, list_transform(list_filter(string_split_regex(line, '[\x09-\x0D\x20]+'), lambda t: t <> ''),
                lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tok FROM lines),
l AS (SELECT doc_id, pos, tok, array_to_string(tok, ' ') AS sig, CASE WHEN len(tok) >= 50 THEN 2 ELSE 10 END AS need,
             concat(len(tok), ' ', array_to_string(tok[1:3], ' ')) AS leaf FROM toks WHERE len(tok) > 0),
big AS (SELECT leaf FROM l GROUP BY leaf, need HAVING count(DISTINCT doc_id) >= need),
-- every step settles the most frequent line of each leaf that could still recur, and all lines like it
tree AS (SELECT leaf, need, sig, any_value(tok) AS tok, count(DISTINCT doc_id) AS d, CAST(NULL AS VARCHAR) AS template
         FROM l JOIN big USING (leaf) GROUP BY leaf, need, sig
         UNION ALL
         SELECT leaf, need, sig, tok, d, CASE WHEN list_sum(list_transform(range(1, len(tok) + 1),
                    lambda i: CAST(tok[i] = stok[i] AS INTEGER))) >= CAST(0.7 AS DOUBLE) * len(tok) THEN ssig END
         FROM (SELECT leaf, need, sig, tok, d, first_value(tok) OVER w AS stok, first_value(sig) OVER w AS ssig,
                      sum(d) OVER (PARTITION BY leaf) AS s
               FROM tree WHERE template IS NULL WINDOW w AS (PARTITION BY leaf ORDER BY d DESC, sig DESC))
         WHERE s >= need),
done AS (SELECT sig, template FROM tree WHERE template IS NOT NULL),
hot AS (SELECT template FROM l JOIN done USING (sig) GROUP BY template, need HAVING count(DISTINCT doc_id) >= need),
gone AS (SELECT doc_id, list(DISTINCT pos) AS gone FROM l JOIN done USING (sig) JOIN hot USING (template) GROUP BY doc_id)
SELECT raw.doc_id, CAST(coalesce(len(parts), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped,
       md5(coalesce(CASE WHEN gone IS NULL THEN text ELSE array_to_string(
           list_transform(list_filter(range(1, len(parts) + 1), lambda i: NOT list_contains(gone, i - 1)), lambda i: parts[i]),
           chr(10)) END, '')) AS clean_md5
FROM raw LEFT JOIN gone ON raw.doc_id = gone.doc_id"""


@query
def op3_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    from quarry.llm import license_scan as S

    docs = table(spark, sf, "documents")
    return S.by_document(docs, S.train(docs))


@query
def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quarry.llm import hard_negatives as H

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return H.mine(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, label)


ORACLE["op13_hard_negatives"] = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id, c.label,
             CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) AS BIGINT) AS score
      FROM e a JOIN e c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score,
       score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE label <> own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10"""


@query
def op12_tokenizer_alignment(spark: SparkSession, sf: str) -> DataFrame:
    from quarry.llm import tokenizer_alignment as A

    return A.align(table(spark, sf, "documents"), *vocabulary_pair())[0]


@query
def op11_page_difference(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quarry.llm import page_difference as P

    out = P.extract(table(spark, sf, "pages")).select("page_id", "url", F.array_join("texts", "\n\n").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
