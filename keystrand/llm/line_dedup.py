"""Line deduplication by winnowing over line hashes, in DataFrame functions only.

A line is what stands between newlines; lines without a word are left out of
account.  The gram of a line is the shortest sequence of lines from it on that
holds `GRAM_WORDS` words; a gram's hash is that of its line hashes.  Of the grams
that begin within `WINDOW_WORDS` words of a line, those of least hash are anchors.
So nothing shorter than GRAM_WORDS words is ever matched, and two runs of equal
lines of GRAM_WORDS + WINDOW_WORDS words always have an anchor in common.

An anchor has up to three keys: its gram's hash, and that with the hash of the line
before or after the gram, so that an earlier text that holds less of a run does not
hide one that holds more.  The first anchor of a key in a document is joined with the
key's first occurrence of all, by (id, place), and further ones with the one before
them in the document, so that a document that repeats itself has few diagonals.  Along
the diagonal of the two places lines are compared both ways, and the longest run of
equal lines around the anchor is deleted from the later place.  Lines are compared up
to `REACH` lines from an anchor, and where a run goes further, eight times as far, and
so on.  A deleted line always has an equal line at an earlier place, so one copy of
each stays.

What remains of a run that is repeated is lines at its edge, where each key of the
nearest anchor occurs first in a text that holds less of the run.  Runs of fewer than
GRAM_WORDS words are left alone on purpose, as short lines repeat
without being copies; between that and GRAM_WORDS + WINDOW_WORDS words a run goes if an
anchor falls into it.

All state is keyed by (id, hash of the text).  Only anchors whose gram occurs more than
once are looked at further.  An anchor's key can be hot; its
first place comes from a pre-aggregated minimum, and the joins with it are plain
equi-joins with one row on one side, which the engine splits where they are
skewed.

Edge cases: null texts stay null and have no lines; an empty text has one line
without words; rows with equal id and text are one document and get the same
result; rows of one id with different texts are ordered by the hash of the
text; null ids come first; a text of any length is taken whole; other columns,
whatever their names, are passed through; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _scratch

GRAM_WORDS, WINDOW_WORDS = 25, 25
REACH = 64
MOST_BROADCAST = 32 << 20
WORD = r"[^\x20\x09-\x0D]+"


def _lines(docs: DataFrame) -> DataFrame:
    """One row for each line with a word: its place, its number among such lines, hash and words before it."""
    split = docs.where(F.col("text").isNotNull()).select("id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    rows = split.select("id", "th", "pos", F.xxhash64("line").alias("h"), F.regexp_count("line", F.lit(WORD)).alias("w")).where("w > 0")
    order = Window.partitionBy("id", "th").orderBy("pos")
    rows = rows.withColumn("before", F.lag("pos").over(order)).where("before is null or before <> pos").drop("before")
    return rows.withColumn("s", F.coalesce(F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("i", F.row_number().over(order))


def _anchors(lines: DataFrame, gram: int, window: int) -> DataFrame:
    """lines with `g`, the hash of the line's gram, and whether it is an anchor."""
    order = Window.partitionBy("id", "th").orderBy("s")
    here = order.rangeBetween(0, gram - 1)
    out = lines.withColumn("n", F.count("*").over(here)).withColumn("last", F.lag("h").over(order))
    # A gram has at most `gram` lines, as each has a word.
    out = out.withColumn("hs", F.collect_list("h").over(order.rowsBetween(0, gram))).withColumn("next", F.get("hs", F.col("n")))
    out = out.withColumn("g", F.when(F.sum("w").over(here) >= gram, F.xxhash64(F.slice("hs", 1, F.col("n").cast("int"))))).drop("hs", "n")
    out = out.withColumn("least", F.min("g").over(order.rangeBetween(0, window - 1)))
    anchor = F.col("g").isNotNull() & (F.max("least").over(order.rangeBetween(-(window - 1), 0)) == F.col("g"))
    keys = F.array_compact(F.array("g", F.when(F.col("last").isNotNull(), F.xxhash64("g", "last", F.lit(1))), F.when(F.col("next").isNotNull(), F.xxhash64("g", "next", F.lit(2)))))
    return out.withColumn("keys", F.when(anchor, keys)).drop("g", "least", "last", "next")


def _runs(lines: DataFrame, diagonals: DataFrame, reach: int) -> DataFrame:
    """Lines (pos, w) of the runs around the anchors `at` of each diagonal, and whether the run may go on beyond the lines that were compared."""
    key = ["id", "th", "id0", "th0", "d"]
    cell = lambda i: F.floor(i / reach).cast("int")
    cells = F.array_distinct(F.flatten(F.transform("at", lambda a: F.array(cell(a) - 1, cell(a), cell(a) + 1))))
    dg = diagonals.withColumn("cells", cells).withColumn("cell", F.explode("cells")).alias("g")
    mine = lines.select("id", "th", "i", "h", "pos", "w", cell(F.col("i")).alias("cell")).alias("m")
    there = lines.select(F.col("id").alias("id0"), F.col("th").alias("th0"), F.col("i").alias("i0"), F.col("h").alias("h")).alias("t")
    same = F.col("g.id").eqNullSafe(F.col("m.id")) & (F.col("g.th") == F.col("m.th")) & (F.col("g.cell") == F.col("m.cell"))
    along = dg.join(mine, same).select(*(f"g.{k}" for k in key), "g.cells", "m.i", "m.h", "m.pos", "m.w", (F.col("m.i") + F.col("g.d")).alias("i0"), F.array_contains("g.at", F.col("m.i")).alias("hit")).alias("a")
    equal = along.join(there, F.col("a.id0").eqNullSafe(F.col("t.id0")) & (F.col("a.th0") == F.col("t.th0")) & (F.col("a.i0") == F.col("t.i0")) & (F.col("a.h") == F.col("t.h"))).select("a.*")
    # Islands of places that follow each other; those with an anchor are runs to delete.
    island = equal.withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy(*key).orderBy("i")))
    run = Window.partitionBy(*key, "run")
    runs = island.withColumn("any", F.max("hit").over(run)).withColumn("lo", F.min("i").over(run)).withColumn("hi", F.max("i").over(run)).where("any")
    inside = lambda i: F.array_contains("cells", cell(i))
    return runs.select(*key, "pos", "w", (((F.col("lo") > 1) & ~inside(F.col("lo") - 1)) | ~inside(F.col("hi") + 1)).alias("open"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM_WORDS, window: int = WINDOW_WORDS, reach: int = REACH) -> DataFrame:
    """(id, th, pos, w): the lines to delete, th being xxhash64 of the text."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lines = _scratch.write(_anchors(_lines(docs), gram, window), "lines")
    _scratch.tidy(docs.sparkSession)
    # A key occurs again only where its gram, the first key of its anchor, does; most grams are in the table once.
    held = lines.where("keys is not null").select(F.col("keys")[0].alias("gram"), "keys", "id", "th", "i")
    many = _scratch.write(held.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "many", small=True)
    own = Window.partitionBy("id", "th", "g").orderBy("i")
    anchors = _scratch.by_ids(held, "gram", many, "left_semi", MOST_BROADCAST // 4).select(F.explode("keys").alias("g"), "id", "th", "i")
    anchors = _scratch.write(anchors.withColumn("prev", F.lag("i").over(own)), "anchors")
    first = anchors.groupBy("g").agg(F.min(F.struct("id", "th", "i")).alias("f"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = anchors.where("prev is not null").select("id", "th", F.col("id").alias("id0"), F.col("th").alias("th0"), (F.col("prev") - F.col("i")).alias("d"), "i")
    later = anchors.where("prev is null").join(first, "g").where(~F.struct("id", "th", "i").eqNullSafe(F.col("f")))
    later = later.select("id", "th", F.col("f.id").alias("id0"), F.col("f.th").alias("th0"), (F.col("f.i") - F.col("i")).alias("d"), "i")
    # A diagonal: a later document, an earlier one (or itself) and the distance of the two places; `at` are the anchors on it.
    diagonals = _scratch.write(later.union(again).groupBy("id", "th", "id0", "th0", "d").agg(F.collect_set("i").alias("at")), "diagonals")
    for used in (many, anchors):
        _scratch.drop(used)
    _scratch.tidy(docs.sparkSession)
    found = _scratch.write(_runs(lines, diagonals, reach), "runs")
    out, open_ = found.where("not open"), found.where("open")
    while not open_.isEmpty():
        reach *= 8
        key = ["id", "th", "id0", "th0", "d"]
        more = open_.select(*key).distinct().alias("o")
        more = diagonals.alias("g").join(more, F.expr(" and ".join(f"g.{k} <=> o.{k}" for k in key)), "left_semi")
        found = _scratch.write(_runs(lines, more, reach), "runs")
        out, open_ = out.unionByName(found.where("not open")), found.where("open")
    return out.select("id", "th", "pos", "w").distinct()


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM_WORDS, window: int = WINDOW_WORDS) -> DataFrame:
    """docs with repeated lines cut out of the texts, and two columns more: n_lines_removed and n_words_removed.

    Columns of docs with these names are replaced.
    """
    since = _scratch.mark()
    gone = repeated_lines(docs, id_col, text_col, gram, window).groupBy("id", "th").agg(F.collect_list("pos").alias("gone"), F.count("*").alias("n"), F.sum("w").alias("w"))
    gone = _scratch.write(gone, "repeated")
    _scratch.release(since, gone)
    # The table of lines to delete is small beside the texts: up to MOST_BROADCAST bytes of it are sent to
    # them, so that no text is shuffled; a larger one meets them in a shuffle join.
    wide = F.coalesce(F.octet_length(F.col("id").cast("string")), F.lit(0))
    if (gone.agg(F.sum(48 + wide + 4 * F.col("n"))).first()[0] or 0) <= MOST_BROADCAST:
        gone = F.broadcast(gone)
    kept = docs.drop("n_lines_removed", "n_words_removed")
    joined = kept.alias("k").join(gone.alias("r"), F.col(f"k.{id_col}").eqNullSafe(F.col("r.id")) & (F.xxhash64(F.col(f"k.{text_col}")) == F.col("r.th")), "left")
    parts = F.split(F.col(f"k.{text_col}"), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("r.gone"))
    text = F.when(F.col("r.gone").isNull(), F.col(f"k.{text_col}")).otherwise(F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n"))
    columns = [text.alias(c) if c == text_col else F.col(f"k.`{c}`") for c in kept.columns]
    return joined.select(*columns, F.coalesce("r.n", F.lit(0)).alias("n_lines_removed"), F.coalesce("r.w", F.lit(0)).alias("n_words_removed"))
