"""Line deduplication with a log-template tree, in DataFrame operations only.

Lines are parsed down a tree of fixed depth: by the number of tokens, then by
the first ``DEPTH`` tokens (a token with a digit is variable).  In a leaf the
most frequent line becomes a template; lines that agree with it in at least
``ALIKE`` of the positions join it, and where members differ the field is
generalised to ``<*>``.  This goes on with what is left until the lines of no
leaf could recur together.  A template that recurs is boilerplate: its lines are
dropped.  A line of ``LONG`` or more tokens recurs from ``LEAST_LONG`` documents,
since a whole passage is not met twice by chance; a shorter line, which may be a
commonplace, from ``LEAST_DOCS`` on.

A round settles the most frequent lines of every leaf at once, one in the first
round and up to ``SEEDS`` later: in order of frequency each of them that agrees
with no template before it is one, and every line joins the first template that
it agrees with.  The result is that of one template at a time; the number of
rounds grows with the templates of the largest leaf divided by ``SEEDS``.

Only leaves that reach enough documents are looked at closely.  All counts are
partial before they are shuffled, and joins on a frequent line are plain
shuffle joins that adaptive execution splits, or broadcasts whose size was
counted.

Edge cases: a null text has no line and stays null; lines without a token are
kept and join no template; lines with fewer tokens than ``DEPTH`` stand at the
leaf of the tokens they have; rows with the same id count as one document (null
is an id of its own) and rows with the same id and text get the same result;
other columns are carried unchanged; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.temp import discard
from quarry.session import materialize

DEPTH = 3
ALIKE = 0.7
SEEDS = 64  # lines of a leaf settled in a round; decides the work, not the result
LEAST_DOCS = 10
LONG, LEAST_LONG = 50, 2
BROADCAST_ROWS = 500_000  # of at most two longs
BROADCAST_TOKENS = 250_000  # in rows with token lists


def _tokens(line: Column) -> Column:
    """Tokens of a line, those with a digit masked.  Lines without a digit or
    without white space other than blanks take no regular expression."""
    cut = F.when(line.rlike(r"[\x09\x0B-\x0D]"), F.split(line, r"[\x09-\x0D\x20]+")).otherwise(F.split(line, " "))
    plain = F.filter(cut, lambda t: t != "")
    masked = F.transform(plain, lambda t: F.when(t.rlike("[0-9]"), F.lit("<*>")).otherwise(t))
    return F.when(line.rlike("[0-9]"), masked).otherwise(plain)


def parse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table of all lines with a token: (id, th, pos, leaf, sig, toks, n);
    ``th`` is a hash of the text, ``leaf`` the place in the tree, ``sig`` a
    hash of the masked line and ``n`` its number of tokens."""
    text = F.col(f"`{text_col}`")
    lines = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("th"),
                        F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    # a generator's output is made once and then read by all expressions below
    lines = lines.select("id", "th", "pos", F.explode(F.array(_tokens(F.col("line")))).alias("tok")).where(F.size("tok") > 0)
    leaf = F.xxhash64(F.size("tok"), F.slice("tok", 1, DEPTH))
    return materialize(lines.select("id", "th", "pos", leaf.alias("leaf"), F.xxhash64("tok").alias("sig"),
                                    F.array_join("tok", " ").alias("toks"), F.size("tok").alias("n")), "lines")


def _with(big: DataFrame, small: DataFrame, on: str) -> DataFrame:
    """Join with a key table, broadcast only when counted small."""
    return big.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on)


def _with_seeds(big: DataFrame, seeds: DataFrame) -> DataFrame:
    """Join with the seeds of a leaf, broadcast only when all their tokens are
    few; else both sides are shuffled and sorted, so that nothing has to fit."""
    tokens = F.aggregate("seeds", F.lit(0).cast("long"), lambda n, x: n + F.size(x["tok"]) + 4)
    n = seeds.agg(F.sum(tokens)).first()[0] or 0
    return big.join(F.broadcast(seeds) if n <= BROADCAST_TOKENS else seeds.hint("merge"), "leaf")


def _alike(a: Column, b: Column, alike: float) -> Column:
    """Whether two token lists of one length agree in enough positions."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y)
    return same >= alike * F.size(a)


def templates(lines: DataFrame, least: int = LEAST_DOCS, alike: float = ALIKE, seeds: int = SEEDS) -> DataFrame:
    """Written table (sig, template id, n_docs) of the lines of recurring
    templates; the template id is the ``sig`` of its first line."""
    # the lines of a leaf have one length
    need = F.when(F.col("n") >= LONG, F.lit(min(least, LEAST_LONG))).otherwise(F.lit(least))
    full = lines.select("leaf", "n", "id").distinct().groupBy("leaf", "n").agg(F.count(F.lit(1)).alias("d"))
    full = materialize(full.select("leaf", need.alias("need"), "d").where("d >= need").drop("d"), "leaves")
    # distinct masked lines of the leaves that reach enough documents
    rows = _with(lines.select("leaf", "sig", "id", "toks"), full, "leaf")
    rows = rows.groupBy("leaf", "need", "sig", "id").agg(F.min("toks").alias("toks"))
    rows = rows.groupBy("leaf", "need", "sig").agg(F.count(F.lit(1)).alias("d"), F.min("toks").alias("toks"))
    todo = masked = materialize(rows, "masked")
    order = Window.partitionBy("leaf").orderBy(F.desc("d"), F.desc("toks"))
    shape = "array<struct<sig:bigint,tok:array<string>>>"
    done, most = lines.select("sig", F.col("sig").alias("template"), F.lit(least).alias("need")).limit(0), 1
    while True:
        # a line's documents are counted once per masked line: never too few
        left = todo.groupBy("leaf", "need").agg(F.sum("d").alias("s")).where("s >= need").select("leaf")
        left = materialize(left, "open")
        if left.isEmpty():
            break
        todo = _with(todo, left, "leaf")
        first = todo.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
        # at most ``most`` lines of a leaf
        first = first.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("k", "sig", F.split("toks", " ").alias("tok")))).alias("s"))
        new = F.aggregate("s", F.array().cast(shape), lambda found, x: F.when(
            F.exists(found, lambda t: _alike(x["tok"], t["tok"], alike)), found).otherwise(
            F.concat(found, F.array(F.struct(x["sig"].alias("sig"), x["tok"].alias("tok"))).cast(shape))))
        first = materialize(first.select("leaf", new.alias("seeds")), "seeds")
        # a generator's output is made once: a line is split once for all seeds
        near = _with_seeds(todo, first).withColumn("tok", F.explode(F.array(F.split("toks", " "))))
        joined = F.filter("seeds", lambda t: _alike(F.col("tok"), t["tok"], alike))
        near = near.select("leaf", "need", "sig", "d", "toks", F.get(joined, F.lit(0))["sig"].alias("template"))
        near = materialize(near.withColumn("toks", F.expr("if(template is null, toks, null)")), "round")
        discard(first)
        done = done.union(near.where("template is not null").select("sig", "template", "need"))
        todo = near.where("template is null").select("leaf", "need", "sig", "d", "toks")
        most = min(8 * most, seeds)
    done = materialize(done, "templates")
    discard(masked)
    met = _with(lines.select("sig", "id"), done, "sig").select("template", "need", "id").distinct()
    hot = met.groupBy("template", "need").agg(F.count(F.lit(1)).alias("n_docs")).where("n_docs >= need").drop("need")
    return materialize(done.join(hot, "template").select("sig", "template", "n_docs"), "recurring")


def template_texts(lines: DataFrame, found: DataFrame) -> DataFrame:
    """(template, n_docs, text): each recurring template with ``<*>`` where its
    lines differ."""
    one = _with(lines.select("sig", "toks"), found, "sig").groupBy("template", "n_docs", "sig").agg(F.min("toks").alias("toks"))
    tok = one.select("template", "n_docs", F.posexplode(F.split("toks", " ")).alias("p", "t"))
    tok = tok.groupBy("template", "n_docs", "p").agg(
        F.when(F.min("t") == F.max("t"), F.min("t")).otherwise(F.lit("<*>")).alias("t"))
    # at most one entry per position of a line
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "t"))), lambda x: x["t"]), " ")
    return tok.groupBy("template", "n_docs").agg(text.alias("text"))


def drop_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_DOCS) -> DataFrame:
    """``docs`` in a struct ``row`` with n_lines, n_dropped and clean_text."""
    lines = parse(docs, id_col, text_col)
    found = templates(lines, least).select("sig")
    gone = _with(lines.select("id", "th", "pos", "sig"), found, "sig")
    # at most the lines of one text
    gone = gone.groupBy("id", "th").agg(F.collect_set("pos").alias("gone")).withColumnRenamed("th", "_th")
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("_id"),
                       text.alias("_text"), F.xxhash64(text).alias("th"))
    rows = rows.join(gone, (F.col("th") == F.col("_th")) & F.col("_id").eqNullSafe(F.col("id")), "left")
    parts = F.split("_text", "\n")
    kept = F.when(F.col("gone").isNull(), F.col("_text")).otherwise(F.array_join(F.filter(
        parts, lambda x, i: ~F.array_contains("gone", i)), "\n"))
    return rows.select("row", F.coalesce(F.size(parts), F.lit(0)).alias("_n"), "_text", kept.alias("clean_text"),
                       F.coalesce(F.size("gone"), F.lit(0)).alias("_g")).select(
        "row", F.when(F.col("_text").isNull(), 0).otherwise(F.col("_n")).cast("long").alias("n_lines"),
        F.when(F.col("_g") < 0, 0).otherwise(F.col("_g")).cast("long").alias("n_dropped"), "clean_text")
