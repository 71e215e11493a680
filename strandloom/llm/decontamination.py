"""Benchmark decontamination over a distributed positional inverted index.

1. Count over all documents the terms that the benchmark uses.
2. In each benchmark window take the two rarest terms; only these need lists.
3. Store the index: one row for each such term and document, with positions.
4. Open the list of each window's rarest term, and that of the other one only in
   the documents found; shift both by the terms' places and intersect them.
5. Each alignment that is left is compared word by word with its document, so
   the phrase matches returned are exact.
6. The same two lists give proximity matches: items of which some window's
   rarest terms stand within so many words of each other, in any order.

Only DataFrame functions are used.  Benchmark-side tables are broadcast after
their bytes have been summed against ``BROADCAST_BYTES``; larger ones are joined
by a shuffle, where adaptive execution splits the partitions of hot terms.

Nulls and edge cases: a null or empty text has no words; an item without words
matches nothing; an item shorter than a window is one window; equal items each
count; rows that share a ``doc_id`` (or have none) are judged each by its own
words, in phrases and in proximity; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.shared import ascii_lower, quoted, write_table

#: What stands between words, once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Bytes of a benchmark-side table up to which it is broadcast.
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; a null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def _checked(df: DataFrame) -> DataFrame:
    """``df`` (of numbers, strings, arrays of strings and of small structs), broadcast where its size allows."""
    sizes = {"string": lambda c: F.octet_length(c), "array<string>": lambda c: F.octet_length(F.array_join(c, " ")) + 20 * F.size(c)}
    measure = lambda c, kind: sizes.get(kind, lambda c: 40 * F.size(c) if kind.startswith("array") else F.lit(0))(c)
    size = sum(F.coalesce(measure(c, kind), F.lit(0)) + 16 for c, kind in df.dtypes)
    held = df.agg(F.sum(size.cast("long")).alias("bytes")).first()["bytes"] or 0
    return F.broadcast(df) if held <= BROADCAST_BYTES else df


def _items(bench: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``item_id`` (string), ``terms`` and a row number that tells equal ids apart."""
    rows = bench.select(F.col(item_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("terms"))
    rows = rows.where(F.size("terms") > 0).withColumn("item", F.monotonically_increasing_id())
    return write_table(rows, "benchmark-items")


def term_counts(tokens: DataFrame, items: DataFrame) -> DataFrame:
    """``term, n``: how often the documents use each term of the items, 0 included."""
    vocabulary = items.select(F.explode("terms").alias("term")).distinct()
    used = tokens.select(F.explode("terms").alias("term")).join(_checked(vocabulary), "term")
    return vocabulary.join(used.groupBy("term").agg(F.count("*").alias("n")), "term", "left").na.fill(0, ["n"])


def rarest_pairs(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """``item, start, rare, rare_place, other, other_place``: of each window its two rarest places.

    Of equal counts the earlier place is the rarer; a window of one word is its
    own other.
    """
    length = F.least(F.lit(window), F.size("terms"))
    starts = items.select("item", "terms", F.explode(F.sequence(F.lit(0), F.size("terms") - length)).alias("start"))
    spots = starts.select("item", "start", F.posexplode(F.slice("terms", F.col("start") + 1, length)).alias("at", "term"))
    order = Window.partitionBy("item", "start").orderBy("n", "at")
    ranked = spots.join(counts, "term").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2)
    spot = F.struct("term", (F.col("start") + F.col("at")).alias("place"))
    both = ranked.groupBy("item", "start").agg(F.max(F.when(F.col("rank") == 1, spot)).alias("a"), F.max(F.when(F.col("rank") == 2, spot)).alias("b"))
    both = both.withColumn("b", F.coalesce("b", "a"))
    return both.select("item", "start", F.col("a.term").alias("rare"), F.col("a.place").alias("rare_place"), F.col("b.term").alias("other"), F.col("b.place").alias("other_place"))


def build_index(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """Stored index ``term, row, positions`` of the given terms (column ``term``)."""
    spots = tokens.select("row", F.posexplode("terms").alias("position", "term"))
    lists = spots.join(_checked(terms.select("term").distinct()), "term")
    return write_table(lists.groupBy("term", "row").agg(F.array_sort(F.collect_list("position")).alias("positions")), "index")


def opened_pairs(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """``row, *pairs, first, second``: positions of both terms where a document has both.

    ``pairs`` has ``rare, other`` and what else belongs to a pair.  The list of
    the rarer term comes first; the other one is opened only in its documents.
    """
    first = index.select(F.col("term").alias("rare"), "row", F.col("positions").alias("first")).join(_checked(pairs), "rare")
    second = index.select(F.col("term").alias("other"), "row", F.col("positions").alias("second"))
    return first.join(second, ["row", "other"])


def close_together(first: Column, second: Column, within: int) -> Column:
    """Whether some position of one sorted list is less than ``within`` words from one of the other.

    The nearest of them are neighbours where both lists are merged.
    """
    mark = lambda xs, kind: F.transform(xs, lambda p: p.cast("long") * 2 + kind)
    merged = F.array_sort(F.concat(mark(first, 0), mark(second, 1)))
    after = F.slice(merged, F.lit(2), F.greatest(F.size(merged) - 1, F.lit(0)))
    met = F.zip_with(merged, after, lambda x, y: (x % 2 != y % 2) & (F.shiftright(y, 1) - F.shiftright(x, 1) < within))
    return F.exists(met, lambda m: F.coalesce(m, F.lit(False)))


def matches(index: DataFrame, pairs: DataFrame, items: DataFrame, within: int | None) -> DataFrame:
    """``row, spots, near_items``: alignments ``item, shift`` of windows whose rarest terms meet, and items that come close.

    Windows with the same two rarest terms, of whatever items, are looked up
    together; lists shifted by the terms' places are intersected inside the row.
    """
    windows = F.collect_set(F.struct("item", "rare_place", "other_place")).alias("windows")
    named = pairs.join(_checked(items.select("item", "item_id")), "item")
    sets = write_table(named.groupBy("rare", "other").agg(windows, F.array_sort(F.collect_set("item_id")).alias("names")), "pairs")
    both = opened_pairs(index, sets)
    shifts = lambda w: F.array_intersect(F.transform("first", lambda p: p - w["rare_place"]), F.transform("second", lambda p: p - w["other_place"]))
    spots = F.flatten(F.transform("windows", lambda w: F.transform(shifts(w), lambda shift: F.struct(w["item"].alias("item"), shift.alias("shift")))))
    none = F.array().cast("array<string>")
    near = none if within is None else F.when(close_together(F.col("first"), F.col("second"), within) | (F.col("rare") == F.col("other")), F.col("names")).otherwise(none)
    found = both.select("row", spots.alias("spots"), near.alias("near")).where((F.size("spots") > 0) | (F.size("near") > 0))
    return found.groupBy("row").agg(
        F.array_distinct(F.flatten(F.collect_list("spots"))).alias("spots"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near_items")
    )


def proximity_matches(index: DataFrame, terms: DataFrame, within: int) -> DataFrame:
    """``row, item, position``: all of an item's ``term`` rows within so many words.

    ``terms`` has ``item, term``, any number of terms an item; the position is
    that of the first word of the earliest such span.  Only lists of documents
    that have all of an item's terms are opened; one document's positions of one
    item's terms at a time meet in a window.
    """
    needs = terms.distinct().withColumn("need", F.count("*").over(Window.partitionBy("item")))
    lists = index.join(_checked(needs), "term").select("row", "item", "need", "term", "positions")
    whole = lists.groupBy("row", "item", "need").agg(F.collect_list(F.struct("term", "positions")).alias("lists")).where(F.size("lists") == F.col("need"))
    spots = whole.select("row", "item", "need", F.explode("lists").alias("x")).select("row", "item", "need", "x.term", F.explode("x.positions").alias("position"))
    near = Window.partitionBy("row", "item").orderBy("position").rangeBetween(0, within - 1)
    met = spots.withColumn("met", F.size(F.collect_set("term").over(near)))
    return met.where("met = need").groupBy("row", "item").agg(F.min("position").alias("position"))


def contamination(
    docs: DataFrame,
    bench: DataFrame,
    window: int = 13,
    least_share: tuple[int, int] = (1, 20),
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    keep: tuple[str, ...] = (),
    within: int | None = None,
) -> DataFrame:
    """``doc_id, n_words, n_hit, items, contaminated`` for every row of ``docs``.

    ``items`` are the sorted item ids with a window in the text; a document is
    contaminated when the words hit are at least ``least_share`` of its words.
    ``keep`` names further columns of ``docs`` to hand on; the text moves once.
    With ``within`` there is ``near_items`` as well: items of which some window's
    two rarest terms stand within so many words.
    """
    items = _items(bench, item_col, item_text_col)
    kept = {c: "text" if c == text_col else f"keep_{k}" for k, c in enumerate(keep) if c != id_col}
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(quoted(id_col)).alias("doc_id"),
        words(F.col(quoted(text_col))).alias("terms"),
        *[F.col(quoted(c)).alias(held_as) for c, held_as in kept.items()],
    )
    # Split once; every step reads this table, and rows have a number of their own.
    tokens = write_table(texts.withColumn("n_words", F.size("terms").cast("long")), "tokens")
    counts = write_table(term_counts(tokens, items), "term-counts")
    pairs = write_table(rarest_pairs(items, counts, window), "rarest")
    index = build_index(tokens, pairs.select(F.explode(F.array("rare", "other")).alias("term")))
    found = write_table(matches(index, pairs, items, within), "matches")

    spots = _checked(found.where("size(spots) > 0").select("row", F.explode("spots").alias("x")).select("row", "x.item", "x.shift"))
    spots = tokens.select("row", "terms", "n_words").withColumnRenamed("terms", "words").join(spots, "row").join(_checked(items), "item")
    length = F.least(F.lit(window), F.size("terms"))
    starts = F.filter(
        F.sequence(F.lit(0), F.size("terms") - length),
        lambda s: (F.col("shift") + s >= 0)
        & (F.col("shift") + s + length <= F.col("n_words"))
        & (F.slice("words", F.greatest(F.col("shift") + s, F.lit(0)) + 1, length) == F.slice("terms", s + 1, length)),
    )
    exact = spots.select("row", "item_id", "shift", length.alias("length"), starts.alias("starts")).where("size(starts) > 0")
    covered = F.flatten(
        F.transform("starts", lambda s: F.sequence(F.col("shift") + s, F.col("shift") + s + F.col("length") - 1))
    )
    # A document's own alignments meet.
    hits = exact.select("row", "item_id", covered.alias("covered")).groupBy("row").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).cast("long").alias("n_hit"),
        F.array_sort(F.collect_set("item_id")).alias("items"),
    )
    over, under = least_share
    judged = tokens.select("row", "doc_id", "n_words", *kept.values()).join(hits, "row", "left")
    none, near = F.array().cast("array<string>"), []
    if within is not None:
        judged = judged.join(found.select("row", "near_items"), "row", "left")
        near = [F.coalesce("near_items", none).alias("near_items")]
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return judged.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", none).alias("items"),
        ((n_hit > 0) & (n_hit * under >= F.col("n_words") * over)).alias("contaminated"),
        *near,
        *[F.col(held_as).alias(c) for c, held_as in kept.items()],
    )
