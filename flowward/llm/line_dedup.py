"""Line dedup: maximal runs of lines that occurred before are deleted; DataFrame functions only.

A document is its sequence of non-blank lines, each by number of its text. Distributed prefix doubling
sorts the suffixes of all sequences: after round j a line's rank tells the interval of suffixes that share
2**j lines with it, and two overlapping intervals tell the one that shares any L lines. Lines and runs that
occur once leave the doubling at once, as nothing longer can repeat either. A run counts when it has
``min_words`` words or more; every repeated run is covered by the shortest such windows that begin or end
in it, so looking up these windows' intervals finds exactly the lines of all maximal runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowward.llm.scratch import Scratch

MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"
#: What tells documents apart, in their order: those without an id come last.
DOC = ["no_id", "doc_id", "text_key"]


def _key(text: F.Column) -> F.Column:
    return F.unhex(F.md5(text))


def _lines(docs: DataFrame) -> DataFrame:
    """(``DOC``, pos among the non-blank lines, line in the text, words, digest)."""
    split = F.split("text", "\n")
    numbered = F.transform(split, lambda x, i: F.struct(i.alias("line"), x.alias("x"), F.regexp_count(x, F.lit(WORD)).alias("words")))
    filled = F.filter(numbered, lambda s: s["words"] > 0)
    doc = [F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("doc_id")]
    rows = docs.select(*doc, _key(F.col("text")).alias("text_key"), F.posexplode(filled).alias("pos", "s"))
    digest = F.unhex(F.substring(F.sha2(F.col("s.x"), 256), 1, 32)).alias("digest")
    return rows.select(*DOC, "pos", F.col("s.line").alias("line"), F.col("s.words").cast("long").alias("words"), digest)


def _ranked(scratch: Scratch, distinct: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` of the repeated rows with a rank in their order, written."""
    parts = max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = distinct.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return scratch.cut(ordered.withColumn("rank", F.monotonically_increasing_id()))


class RepeatedLines:
    """``covered``: (``DOC``, line) of all lines in runs that occurred before."""

    def __init__(self, docs: DataFrame, min_words: int = MIN_WORDS):
        self.min_words = min_words
        self.scratch = Scratch(docs.sparkSession, "line-dedup")
        lines = self.scratch.cut(_lines(docs))
        counts = lines.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
        first = _ranked(self.scratch, counts, ["digest"])
        start = lines.join(first, "digest").drop("digest").dropDuplicates([*DOC, "pos"])
        level = self.scratch.cut(start)
        self.scratch.drop(lines, first)
        self.positions = level
        windows = self._windows(level)
        named, width = [self._named(windows, level, 1)], 1
        while True:
            level = self._doubled(level, width)
            width *= 2
            if not level.take(1):
                break
            named.append(self._named(windows, level, width))
            if 2 * width > min_words:  # a shortest window has at most min_words lines
                break
        self.covered = self._covered(named)

    def _doubled(self, level: DataFrame, width: int) -> DataFrame:
        """Ranks by twice as many lines; positions whose run occurs once are left out."""
        follows = Window.partitionBy(*DOC).orderBy("pos").rangeBetween(width, width)
        pairs = level.withColumn("next", F.max("rank").over(follows)).where("next is not null")
        pairs = self.scratch.cut(pairs.withColumnRenamed("rank", "head"))
        repeated = pairs.groupBy("head", "next").agg(F.count("*").alias("n")).where("n > 1").select("head", "next")
        ranks = _ranked(self.scratch, repeated, ["head", "next"])
        doubled = self.scratch.cut(pairs.join(ranks, ["head", "next"]).drop("head", "next"))
        self.scratch.drop(pairs, ranks)
        return doubled

    def _windows(self, level: DataFrame) -> DataFrame:
        """(doc, pos, size in lines) of the shortest windows with enough words, from each line on and up to each line."""
        doc = Window.partitionBy(*DOC).orderBy("pos")
        run = level.withColumn("run", F.col("pos") - F.row_number().over(doc))
        inside = Window.partitionBy(*DOC, "run").orderBy("pos")
        run = run.withColumn("to_word", F.sum("words").over(inside)).withColumn("from_word", F.col("to_word") - F.col("words"))
        onward = Window.partitionBy(*DOC, "run").orderBy("from_word").rangeBetween(0, self.min_words - 1)
        before = Window.partitionBy(*DOC, "run").orderBy("to_word").rangeBetween(1 - self.min_words, 0)
        spans = run.select(
            *DOC,
            "pos",
            (F.max("pos").over(onward) - F.col("pos") + 1).alias("on_size"),
            (F.max("to_word").over(onward) - F.col("from_word")).alias("on_words"),
            F.min("pos").over(before).alias("back_pos"),
            (F.col("to_word") - F.min("from_word").over(before)).alias("back_words"),
        )
        onward_rows = spans.where(F.col("on_words") >= self.min_words).select(*DOC, "pos", F.col("on_size").alias("size"))
        back_rows = spans.where(F.col("back_words") >= self.min_words).select(
            *DOC, F.col("back_pos").alias("pos"), (F.col("pos") - F.col("back_pos") + 1).alias("size")
        )
        return self.scratch.cut(onward_rows.unionByName(back_rows).distinct())

    def _named(self, windows: DataFrame, level: DataFrame, width: int) -> DataFrame:
        """Windows of ``width`` to below 2 * ``width`` lines with the two ranks that name them."""
        mine = windows.where(F.col("size").between(width, 2 * width - 1))
        ranks = level.select(*DOC, "pos", "rank")
        head = ranks.withColumnRenamed("rank", "head")
        tail = ranks.withColumnRenamed("rank", "tail").withColumnRenamed("pos", "tail_pos")
        both = mine.join(head, [*DOC, "pos"]).withColumn("tail_pos", F.col("pos") + F.col("size") - width)
        return self.scratch.cut(both.join(tail, [*DOC, "tail_pos"]).drop("tail_pos"))

    def _covered(self, named: list[DataFrame]) -> DataFrame:
        windows = named[0]
        for more in named[1:]:
            windows = windows.unionByName(more)
        place = F.struct(*DOC, "pos")
        first = windows.groupBy("size", "head", "tail").agg(F.min(place).alias("first"), F.count("*").alias("n"))
        # written before it is joined, so that Spark can split a run that very many documents share
        first = self.scratch.cut(first.where("n > 1").drop("n"))
        later = windows.join(first, ["size", "head", "tail"]).where(place > F.col("first"))
        covered = later.select(*DOC, F.explode(F.sequence("pos", F.col("pos") + F.col("size") - 1)).alias("pos")).distinct()
        return self.scratch.cut(covered.join(self.positions.select(*DOC, "pos", "line"), [*DOC, "pos"]).drop("pos"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from ``text``, and ``removed_lines`` (line numbers).

    A copy is later by (doc_id, text, line), documents without an id last; the first copy stays. Lines compare
    exactly, words stand between white space, blank lines neither count nor break a run and stay. Rows with equal
    id and text are one document: they lose the same lines, and not for each other's sake. Null texts stay null.
    Other columns stay; a column ``removed_lines`` of the input gives way. Ids have to compare as long.
    """
    own = [c for c in docs.columns if c != "removed_lines"]
    docs = docs.select(*own)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    repeated = RepeatedLines(narrow.where("text is not null"), min_words)
    gone = repeated.covered.groupBy(*DOC).agg(F.array_sort(F.collect_set("line")).alias("__gone"))
    doc_id = F.when(~F.col("no_id"), F.col("doc_id"))
    gone = gone.select(doc_id.alias("__id"), F.col("text_key").alias("__key"), "__gone")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (_key(F.col("text").cast("string")) == F.col("__key"))
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__gone")
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    )
    joined = docs.join(gone, same, "left")
    removed = F.coalesce("__gone", F.array().cast("array<int>")).alias("removed_lines")
    return joined.select(*[text.alias("text") if c == "text" else F.col(c) for c in own], removed)
