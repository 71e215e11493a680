"""Distance to the k-th nearest haplotype of a block, by multi-index hashing with a growing radius.

A haplotype's alleles are cut into pieces.  Two haplotypes that differ in at most
``pieces * (t + 1) - 1`` places differ in at most ``t`` places of some piece, so
they agree in it once the right ``t`` places are left out: haplotypes that share
a block, a piece, a choice of places and what is left of the piece are compared,
and no others.  Rounds raise ``t`` for the haplotypes whose k-th distance is not
yet within what a round guarantees; with all places of a piece left out
everything is compared, so the result is exact.  Built-in functions only.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.sources.scratch import written

#: Alleles of a piece; alleles of a word that is compared at once.
PIECE, WORD = 8, 60


def allele_words(alleles: Column) -> Column:
    """Bits of the alleles' digits: an array of structs of four whole numbers, a struct for each ``WORD`` alleles."""
    starts = F.sequence(F.lit(0), F.expr(f"(greatest(char_length(alleles), 1) - 1) div {WORD}"))
    planes = [F.translate(alleles, "0123456789", "".join(str(d >> k & 1) for d in range(10))) for k in range(4)]
    part = lambda plane, s: F.coalesce(F.conv(F.substring(plane, s * WORD + 1, F.lit(WORD)), 2, 10).cast("long"), F.lit(0).cast("long"))
    return F.transform(starts, lambda s: F.struct(*[part(p, s.cast("int")).alias(f"b{k}") for k, p in enumerate(planes)]))


def differences(a: Column, b: Column) -> Column:
    """In how many places two haplotypes of one length differ."""
    differ = lambda x, y, k: x[f"b{k}"].bitwiseXOR(y[f"b{k}"])

    def places(x: Column, y: Column) -> Column:
        out = differ(x, y, 0)
        for k in (1, 2, 3):
            out = out.bitwiseOR(differ(x, y, k))
        return F.bit_count(out)

    return F.aggregate(F.zip_with(a, b, places), F.lit(0), lambda s, n: s + n)


def _keys(haps: DataFrame, t: int, piece: int) -> DataFrame:
    """``chrom, block_ord, id, part, mask, rest``: each piece without each choice of ``t`` places."""
    parts = F.sequence(F.lit(0), F.expr(f"(greatest(char_length(alleles), 1) - 1) div {piece}"))
    rows = haps.select("chrom", "block_ord", "id", "alleles", F.explode(parts).alias("part"))
    begin = (F.col("part") * piece + 1).cast("int")
    rows = rows.withColumn("piece", F.rpad(F.substring("alleles", begin, F.lit(piece)), piece, " "))
    left_out = list(combinations(range(piece), t))
    rest = lambda places: F.concat(F.lit(""), *[F.substring("piece", k + 1, 1) for k in range(piece) if k not in places])
    masks = F.array(*[F.struct(F.lit(n).alias("mask"), rest(places).alias("rest")) for n, places in enumerate(left_out)])
    return rows.select("chrom", "block_ord", "id", "part", F.explode(masks).alias("x")).select("chrom", "block_ord", "id", "part", "x.mask", "x.rest")


def kth_neighbour(distinct: DataFrame, share: int = 10, least: int = 10, piece: int = PIECE) -> DataFrame:
    """``chrom, block_ord, alleles, k, distance``: Hamming distance of each haplotype to its k-th nearest other one.

    ``distinct`` has ``chrom, block_ord, alleles``, each once; k is a block's
    haplotypes divided by ``share``, at least ``least``, and at most all others.
    A haplotype alone in its block is left out.
    """
    if piece < 1 or share < 1 or least < 1:
        raise ValueError("share, least and piece must be at least 1")
    block = Window.partitionBy("chrom", "block_ord")
    counts = distinct.groupBy("chrom", "block_ord").agg(F.count("*").alias("r"))
    rows = distinct.select("chrom", "block_ord", "alleles", (F.row_number().over(block.orderBy("alleles")) - 1).alias("id")).join(counts, ["chrom", "block_ord"])
    k = F.least(F.greatest(F.expr(f"r div {share}"), F.lit(least)), F.col("r") - 1)
    rows = rows.where("r > 1").select("chrom", "block_ord", "id", "alleles", k.alias("k"), allele_words(F.col("alleles")).alias("words"))
    haps = written(rows, "haplotypes")
    todo, found = haps.select("chrom", "block_ord", "id"), []
    for t in range(piece + 1):
        keys = _keys(haps, t, piece)
        place = ["chrom", "block_ord", "part", "mask", "rest"]
        mine = keys.join(todo, ["chrom", "block_ord", "id"], "left_semi").withColumnRenamed("id", "a")
        pairs = mine.join(keys.withColumnRenamed("id", "b"), place).where("a <> b").select("chrom", "block_ord", "a", "b").distinct()
        side = lambda name: haps.select("chrom", "block_ord", F.col("id").alias(name), F.col("words").alias(f"words_{name}"))
        apart = pairs.join(side("a"), ["chrom", "block_ord", "a"]).join(side("b"), ["chrom", "block_ord", "b"])
        tally = apart.groupBy("chrom", "block_ord", "a", differences(F.col("words_a"), F.col("words_b")).alias("distance")).agg(F.count("*").alias("n"))
        within = F.sum("n").over(Window.partitionBy("chrom", "block_ord", "a").orderBy("distance"))
        reached = tally.withColumn("within", within).withColumnRenamed("a", "id").join(haps.select("chrom", "block_ord", "id", "k", "alleles"), ["chrom", "block_ord", "id"])
        nearest = reached.where("within >= k").groupBy("chrom", "block_ord", "id", "k", "alleles").agg(F.min("distance").alias("distance"))
        pieces = F.expr(f"(greatest(char_length(alleles), 1) - 1) div {piece} + 1")
        sure = nearest.where(F.col("distance") < pieces * (t + 1)) if t < piece else nearest
        done = written(sure.select("chrom", "block_ord", "id", "alleles", "k", "distance"), f"near-{t}")
        found.append(done)
        todo = written(todo.join(done, ["chrom", "block_ord", "id"], "left_anti"), "unsettled")
        if todo.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("chrom", "block_ord", "alleles", "k", "distance")
