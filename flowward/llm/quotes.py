"""Chat formatting: quoted passages are linked to the messages they come from and then taken out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowward.llm.scratch import Scratch

#: A line that leads over to a quotation when one follows: "... wrote:" in four languages.
LEAD = r"(?i)\b(wrote|writes|schrieb|escribió|a écrit)\s*:\s*$"
WHITE = " \t\n\x0b\f\r"
KEY = ["conv_id", "turn"]
#: Of normalised text.
SENTENCE = r"(?<=[.!?…])\s+|(?<=[。！？])\s*"
#: Words in a row that link a part of a message that is no whole line, paragraph or sentence.
WINDOW = 8
#: Words that are cut into windows at a time.
BLOCK = 4096


def _marks(line: F.Column) -> F.Column:
    """What stands before the body of a quoted line: blanks and ``>`` up to the last ``>``, in one walk over them."""
    body = F.ltrim(line, F.lit(WHITE + ">"))
    return F.rtrim(F.left(line, F.length(line) - F.length(body)), F.lit(WHITE))


def _level(marks: F.Column) -> F.Column:
    return F.length(marks) - F.length(F.replace(marks, F.lit(">")))


def _made(df: DataFrame, name: str, value: F.Column) -> DataFrame:
    """``df`` with ``value`` worked out once a row: functions over its entries would else work it out at each entry."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _normal(text: F.Column) -> F.Column:
    """Lower case, white space as single blanks: the same passage however it was wrapped."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _lines(messages: DataFrame) -> DataFrame:
    """Each message with ``lines``: (at, level, body, next level)."""
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    with_level = F.transform(
        split,
        lambda x, i: F.struct(
            i.alias("at"), _level(_marks(x)).alias("level"), F.substring(x, F.length(_marks(x)) + 1, F.length(x)).alias("body")
        ),
    )
    named = _made(messages, "parsed", with_level)
    # a lead-in is an own line right before a quotation
    lead = F.transform(
        "parsed",
        lambda s, i: s.withField(
            "lead",
            (s["level"] == 0)
            & s["body"].rlike(LEAD)
            & (F.coalesce(F.get(F.col("parsed"), i + 1)["level"], F.lit(0)) > 0),
        ),
    )
    return named.withColumn("lines", lead).drop("parsed")


def _own_text() -> F.Column:
    own = F.filter("lines", lambda s: (s["level"] == 0) & ~s["lead"])
    return F.trim(F.array_join(F.transform(own, lambda s: s["body"]), "\n"), F.lit(WHITE))


def _hashed(text: F.Column) -> F.Column:
    return F.unhex(F.md5(text))


def _sentences(normal: F.Column) -> F.Column:
    return F.filter(F.split(normal, SENTENCE), lambda x: x != "")


def _blocks(words: F.Column) -> F.Column:
    """``words`` in runs that together have all its windows, each once: no array has those of a whole long text."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(BLOCK))
    return F.transform(starts, lambda i: F.slice(words, i + 1, BLOCK + WINDOW - 1))


def _word_windows(words: F.Column) -> F.Column:
    """Every run of ``WINDOW`` entries of ``words``."""
    last = F.size(words) - WINDOW
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(words, i + 1, WINDOW))


def _passages(parsed: DataFrame) -> DataFrame:
    """Quoted passages (conv_id, turn, level, hash, size, n_lines, lines).

    Runs of lines of one level and their lines one by one; paragraphs between blank quoted lines, sentences of these and
    windows of words of a run, which may begin and end inside lines. ``lines`` are the lines of a passage, ``n_lines``
    their number, 0 for those of the second kind.
    """
    rows = parsed.where(F.exists("lines", lambda s: s["level"] > 0)).select(
        *KEY, F.md5("text").alias("text_key"), F.explode("lines").alias("s")
    )
    rows = rows.select(*KEY, "text_key", "s.*").distinct()
    text = Window.partitionBy(*KEY, "text_key").orderBy("at")  # the lines of one message
    begins = F.coalesce(F.col("level") != F.lag("level").over(text), F.lit(True))
    rows = rows.withColumn("normal", _normal(F.col("body"))).withColumn("begins", begins)
    rows = rows.withColumn("run", F.sum(F.col("begins").cast("int")).over(text))
    rows = rows.withColumn("paragraph", F.sum((F.col("begins") | (F.col("normal") == "")).cast("int")).over(text))
    rows = rows.where("level > 0 and normal != ''")
    line = F.struct("at", "normal")
    joined = lambda lines: F.array_join(F.transform(lines, lambda s: s["normal"]), " ")
    places = lambda lines: F.transform(lines, lambda s: s["at"])
    whole = rows.groupBy(*KEY, "text_key", "run", "level").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    single = rows.select(*KEY, "level", "normal", F.lit(1).alias("n_lines"), F.array("at").alias("lines"))
    runs = whole.where(F.size("lines") > 1).select(
        *KEY, "level", joined(F.col("lines")).alias("normal"), F.size("lines").alias("n_lines"), places(F.col("lines")).alias("lines")
    )
    parts = rows.groupBy(*KEY, "text_key", "paragraph", "level").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    parts = parts.withColumn("whole", joined(F.col("lines")))
    units = F.array_distinct(F.concat(F.array("whole"), _sentences(F.col("whole"))))
    parts = parts.select(*KEY, "level", "lines", F.explode(units).alias("normal"))
    covered = F.filter("lines", lambda s: F.col("normal").contains(s["normal"]) | s["normal"].contains(F.col("normal")))
    covered = F.when(F.size(covered) > 0, covered).otherwise(F.slice("lines", 1, 1))
    parts = parts.select(*KEY, "level", "normal", F.lit(0).alias("n_lines"), places(covered).alias("lines"))
    words = F.flatten(
        F.transform("lines", lambda s: F.transform(F.split(s["normal"], " "), lambda w: F.struct(s["at"].alias("at"), w.alias("normal"))))
    )
    windows = _made(whole, "words", words).select(*KEY, "level", F.explode(_blocks(F.col("words"))).alias("words"))
    windows = windows.select(*KEY, "level", F.explode(_word_windows(F.col("words"))).alias("lines"))
    windows = windows.select(
        *KEY,
        "level",
        joined(F.col("lines")).alias("normal"),
        F.lit(0).alias("n_lines"),
        F.array_distinct(places(F.col("lines"))).alias("lines"),
    )
    every = single.unionByName(runs).unionByName(parts).unionByName(windows)
    return every.select(*KEY, "level", _hashed(F.col("normal")).alias("hash"), F.length("normal").alias("size"), "n_lines", "lines")


def _originals(parsed: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, hash, origin): where a message's own text, paragraph, line, sentence or window of words stood first.

    Only of conversations that have quotations.
    """
    quoting = parsed.where(F.exists("lines", lambda s: s["level"] > 0)).select("conv_id").distinct()
    quoting = scratch.cut(quoting)  # written, so that Spark can split a conversation that many rows have
    own = parsed.select(*KEY, _own_text().alias("own")).where("own != ''").join(quoting, "conv_id", "left_semi")
    paragraphs = F.transform(F.split("own", r"\n[ \t]*\n"), lambda u: _normal(u))
    units = F.concat(F.array(_normal(F.col("own"))), F.transform(F.split("own", "\n"), lambda u: _normal(u)))
    whole = _made(own, "words", F.split(_normal(F.col("own")), " "))
    blocks = whole.select(*KEY, F.explode(_blocks(F.col("words"))).alias("words"))
    windows = F.transform(_word_windows(F.col("words")), lambda w: F.array_join(w, " "))
    windows = blocks.select(*KEY, F.explode(windows).alias("unit"))
    own = own.select(*KEY, units.alias("units"), paragraphs.alias("paragraphs"))
    sentences = F.flatten(F.transform("paragraphs", _sentences))
    units = F.array_distinct(F.concat("units", "paragraphs", sentences))
    rows = own.select(*KEY, F.explode(units).alias("unit")).where("unit != ''").unionByName(windows)
    return rows.groupBy("conv_id", _hashed(F.col("unit")).alias("hash")).agg(F.min("turn").alias("origin"))


def _parents(parsed: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, origin, linked): the earlier message that most of the outermost linked quotation comes from."""
    originals = scratch.cut(_originals(parsed, scratch))  # written, so that Spark can split a passage that many quote
    found = _passages(parsed).join(originals, ["conv_id", "hash"]).where("origin < turn")
    found = found.select(*KEY, "level", "origin", "size", "n_lines", F.posexplode("lines").alias("place", "at"))
    once = lambda name: F.sum(F.when(F.col("place") == 0, F.col(name)).otherwise(0)).alias(name)
    sums = found.groupBy(*KEY, "level", "origin", "at").agg(once("size"), once("n_lines"))
    # runs and lines count as they are, or else the lines that sentences and windows touch
    lines = F.greatest(F.sum("n_lines"), F.count("*")).alias("lines")
    sums = sums.groupBy(*KEY, "level", "origin").agg(F.sum("size").alias("size"), lines)
    best = F.max(F.struct(-F.col("level"), "size", "origin", "lines")).alias("best")
    return sums.groupBy(*KEY).agg(best).select(*KEY, F.col("best.origin").alias("origin"), F.col("best.lines").alias("linked"))


def _threads(scratch: Scratch, nodes: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to) with ``root_turn`` and ``depth``, by doubling of the way to the root."""
    table = nodes.select(*KEY, F.col("reply_to").alias("up"), F.when(F.col("reply_to").isNull(), 0).otherwise(1).alias("steps"))
    table = table.withColumn("root", F.coalesce("up", "turn"))
    table = scratch.cut(table)
    while table.where("up is not null").take(1):
        above = table.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), "root", F.col("steps").alias("more"))
        settled = table.where("up is null")
        moved = table.where("up is not null").drop("root").join(above, ["conv_id", "up"], "left")
        moved = moved.select(
            *KEY,
            F.col("up2").alias("up"),
            (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
            F.coalesce("root", "up").alias("root"),
        )
        following = scratch.cut(settled.unionByName(moved))
        scratch.drop(table)
        table = following
    return table.select(*KEY, F.col("root").alias("root_turn"), F.col("steps").alias("depth"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """Conversations in reply order, without quotations: one row per input row.

    Quoted passages (lines after ``>``, nested ones by their level) are normalised, hashed and joined to the first
    message of the conversation with that text, paragraph, line, sentence or run of ``WINDOW`` words. ``reply_to`` is the message most of the outermost
    linked quotation comes from (ties: the later one), ``by_quote`` tells so; else it is the message one turn before,
    or null. ``own_text`` is the text without quotations and the lines that lead over to them, ``formatted`` the same
    with its role. Ordered by conv_id, root_turn, depth and turn, every message comes after the one it replies to;
    nothing here is sorted or collected per conversation.

    A null text is an empty one; rows without conversation or turn are roots; rows that repeat a turn share its
    place, and the least reply_to of that turn; other columns are not kept. An empty table has no rows. A line may have
    any number of ``>`` and blanks, a message any number of words: they are cut into windows by blocks of ``BLOCK``.
    """
    scratch = Scratch(messages.sparkSession, "quotes")
    narrow = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    parsed = _lines(narrow)
    placed = parsed.where("conv_id is not null and turn is not null")
    parents = _parents(placed, scratch)
    turns = placed.select(*KEY).distinct()
    previous = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("previous"))
    nodes = turns.join(parents, KEY, "left").join(previous, KEY, "left")
    nodes = nodes.select(
        *KEY, F.coalesce("origin", "previous").alias("reply_to"), F.col("origin").isNotNull().alias("by_quote"), "linked"
    )
    nodes = scratch.cut(nodes)
    threads = nodes.join(_threads(scratch, nodes), KEY)
    own = _own_text()
    rows = parsed.select(
        *KEY,
        "role",
        own.alias("own_text"),
        F.size(F.filter("lines", lambda s: s["level"] > 0)).alias("n_quoted_lines"),
        F.array_max(F.transform("lines", lambda s: s["level"])).alias("quote_depth"),
    )
    rows = rows.join(threads, KEY, "left")
    return rows.select(
        *KEY,
        "role",
        "own_text",
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), "own_text").alias("formatted"),
        "n_quoted_lines",
        F.coalesce("linked", F.lit(0)).cast("long").alias("n_linked_lines"),
        "quote_depth",
        "reply_to",
        F.coalesce("by_quote", F.lit(False)).alias("by_quote"),
        F.coalesce("root_turn", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )
