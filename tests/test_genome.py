import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import normal, posterior
from strandloom.operators import blocks, gram, haplotypes, neighbours, run_log, sampler
from strandloom.sources import dense, sinks, tables, vcf_source
from strandloom.sources.tables import numbered_lines
from strandloom.sources.variants import read_vcf
from strandloom.sources.vcf_source import VcfSource, scan_vcf
from tests.test_operators import HEAD, study, vcf

PART = "chrom string, block_ord int, left_idx int, right_idx int"


@pytest.mark.parametrize("bin_size", [1, 3, 64])
def test_blocks_may_leave_gaps_overlap_and_reach_too_far(spark, bin_size):
    variants = spark.createDataFrame([(c, k) for c in "ab" for k in range(10)], "chrom string, var_idx int")
    parts = [("a", 0, 0, 2), ("a", 1, 5, 7), ("a", 2, 2, 5), ("a", 3, 8, 40), ("a", 4, 6, 4), ("b", 0, 0, 5), ("b", 1, 3, 9), ("b", 2, 3, 9), ("b", 3, 12, 14)]
    got = sorted(map(tuple, blocks.variant_blocks(variants, spark.createDataFrame(parts, PART), bin_size).collect()))
    assert got == sorted((c, k, n) for c, n, a, b in parts for k in range(10) if a <= k <= b)
    with pytest.raises(ValueError):
        blocks.variant_blocks(variants, spark.createDataFrame(parts, PART), 0)


def test_haplotypes_of_overlapping_blocks(spark):
    variants = spark.createDataFrame([("1", k, [k % 2, 1], [0, k % 3 % 2]) for k in range(10)], "chrom string, var_idx int, hap1 array<tinyint>, hap2 array<tinyint>")
    parts = spark.createDataFrame([("1", 0, 0, 5), ("1", 1, 3, 9), ("1", 2, 1, 1)], PART)
    got = {(r["block_ord"], r["sample_idx"], r["hap"]): r["alleles"] for r in haplotypes.haplotype_strings(variants, parts).collect()}
    whole = {(0, 0): "0101010101", (1, 0): "1111111111", (0, 1): "0000000000", (1, 1): "0100100100"}
    assert got == {(n, s, h): t[a : b + 1] for n, a, b in ((0, 0, 5), (1, 3, 9), (2, 1, 1)) for (s, h), t in whole.items()}


def random_vcf(tmp_path, name, seed, rows=60):
    rng = random.Random(seed)
    lines = [(rng.choice("xyz"), rng.randint(1, 10**6), rng.choice([".", f"v{k}", ""]), [f"{rng.randint(0, 1)}|{rng.randint(0, 1)}" + rng.choice(["", "", ":7:x"]) for _ in range(4)]) for k in range(rows)]
    return vcf(tmp_path / name, lines)


@pytest.mark.parametrize("split", [211, 1 << 20])
def test_vcf_source_gives_the_rows_of_the_text_reader(spark, tmp_path, split):
    paths = [random_vcf(tmp_path, f"{k}.vcf", k, 40) for k in range(2)]
    key = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    want = key(read_vcf(spark, paths))
    assert key(scan_vcf(spark, ",".join(paths), splitBytes=split)) == want and len(want) == 80
    (tmp_path / "folder").mkdir()
    for p in paths:
        (tmp_path / "folder" / p.rsplit("/", 1)[1]).write_text(open(p).read().rstrip("\n").replace("\n", "\r\n"))
    assert key(scan_vcf(spark, str(tmp_path / "folder"), splitBytes=split)) == want


def test_vcf_source_options(spark, tmp_path):
    path = vcf(tmp_path / "b.vcf", [("1", 1, "a", ["0|1", "0/1", "0|0", "1|0"]), ("1", 2, "b", ["0|1", "1|1", "0|0", "1|0"])])
    with pytest.raises(Exception, match="not phased"):
        scan_vcf(spark, path).collect()
    assert [(r["var_id"], r["var_idx"]) for r in scan_vcf(spark, path, missing="drop_variant").collect()] == [("b", 0)]
    spark.dataSource.register(VcfSource)
    two = spark.read.format("vcf").option("samples", "s3,s1").option("missing", "drop_variant").load(path).collect()
    assert [(r["hap1"], r["hap2"]) for r in two] == [([1, 1], [1, 0])]
    assert spark.read.format("vcf").schema("var_id string").load(path).count() == 2  # genotypes are not looked at
    for options, told in (({"samples": "nobody"}, "no sample"), ({"missing": "maybe"}, "missing must"), ({"splitBytes": 0}, "splitBytes")):
        with pytest.raises(Exception, match=told):
            spark.read.format("vcf").options(**options).load(path).collect()
    (tmp_path / "c.vcf").write_text("##only meta\n")
    with pytest.raises(Exception, match="no #CHROM line"):
        scan_vcf(spark, str(tmp_path / "c.vcf")).collect()
    (tmp_path / "d.vcf").write_text(HEAD)
    assert scan_vcf(spark, str(tmp_path / "d.vcf")).collect() == []


def test_vcf_source_reads_compressed_files(spark, tmp_path):
    import gzip

    path = random_vcf(tmp_path, "z.vcf", 5)
    with gzip.open(tmp_path / "z.vcf.gz", "wb") as out:
        out.write(open(path, "rb").read())
    key = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert key(scan_vcf(spark, str(tmp_path / "z.vcf.gz"))) == key(scan_vcf(spark, path))


@pytest.mark.parametrize("split", [97, 1 << 20])
def test_vcf_source_reads_the_parts_of_one_text(spark, tmp_path, split):
    path = random_vcf(tmp_path, "whole.vcf", 8, 30)
    lines = open(path).read().splitlines(keepends=True)
    (tmp_path / "parts").mkdir()
    head = next(k for k, line in enumerate(lines) if line.startswith("#CHROM"))
    cuts = [0, head, head + 1, head + 1, head + 12, len(lines)]  # meta lines, names, nothing, two pieces of the rows
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        (tmp_path / "parts" / f"part-{k:05d}.txt").write_text("".join(lines[a:b]))
    key = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    parts = str(tmp_path / "parts")
    assert key(scan_vcf(spark, parts, splitBytes=split)) == key(scan_vcf(spark, path)) == key(read_vcf(spark, parts))
    some = lambda at: key(spark.read.format("vcf").schema("hap1 array<tinyint>, var_id string").option("samples", "s1,s3").load(at))
    assert some(parts) == some(path) and len(some(path)) == 30
    (tmp_path / "parts" / "a.txt").write_text(lines[-1])  # before the names
    with pytest.raises(Exception, match="before a #CHROM line"):
        scan_vcf(spark, parts).collect()


@pytest.mark.parametrize("block", [1, 3, 1 << 10])
def test_every_line_begins_in_one_range(tmp_path, monkeypatch, block):
    monkeypatch.setattr(vcf_source, "BATCH_BYTES", block)
    for text in (b"", b"a", b"\n", b"ab\n\ncdefg\r\nh\n", b"x" * 40 + b"\ny"):
        (tmp_path / "t").write_bytes(text)
        want = [line.removesuffix(b"\r") for line in text.removesuffix(b"\n").split(b"\n")] if text else []
        for size in range(1, len(text) + 2):
            ranges = [(a, min(len(text), a + size)) for a in range(0, len(text), size)]
            assert [x for a, b in ranges for x in vcf_source.lines_of(str(tmp_path / "t"), a, b)] == want
        assert list(vcf_source.lines_of(str(tmp_path / "t"), 0, None)) == want


@pytest.mark.parametrize("size", [3, 1000])
def test_dense_rows_of_any_slices(spark, tmp_path, size):
    rng = np.random.default_rng(size)
    x = rng.integers(0, 3, (8, 11)) * (rng.random((8, 11)) < 0.4)
    x[3], x[:, 5] = 0, 0
    x[0] = 2  # a haplotype of the design has a dose somewhere
    design = spark.createDataFrame([(s, h, f"h{h}", int(x[s, h])) for s in range(8) for h in range(11) if x[s, h]], "sample_idx int, hap_ord int, hap_name string, dose int")
    samples = spark.createDataFrame([(s,) for s in range(8)], "sample_idx int")
    sinks.write_design(design, samples, str(tmp_path / "d"), size)
    sinks.write_design(design, samples, str(tmp_path / "d"), size)  # over the one before
    lines = [r["value"] for r in numbered_lines(spark, str(tmp_path / "d")).orderBy("n").collect()]
    assert lines == ["\t".join(f"h{h}" for h in range(11))] + ["\t".join(map(str, row)) for row in x.tolist()]
    sinks.write_bimbam(design, samples, str(tmp_path / "b"), size)
    lines = [r["value"] for r in numbered_lines(spark, str(tmp_path / "b")).orderBy("n").collect()]
    assert lines == [f"h{h} - - " + " ".join(map(str, x[:, h])) for h in range(11)]
    assert sorted(p.name for p in (tmp_path / "b").iterdir() if p.name.startswith("_")) == ["_SUCCESS"]


def test_dense_cells_have_one_digit(spark):
    cells = spark.createDataFrame([(0, 1, 12)], "row long, col int, value int")
    with pytest.raises(Exception, match="single digit"):
        dense.dense_slices(cells, spark.createDataFrame([(0,)], "row long"), F.lit(3), " ").collect()


def test_normal_functions_against_the_standard_library(spark):
    n = statistics.NormalDist()
    xs = [k / 16 for k in range(-640, 641)] + [1e-12, -1e-300, 38.5, -38.5, 1e9]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", normal.pdf(F.col("x")).alias("d"), normal.cdf(F.col("x")).alias("c")).collect():
        assert abs(r["d"] - n.pdf(r["x"])) < 1e-14 and abs(r["c"] - 0.5 * math.erfc(-r["x"] / math.sqrt(2))) < 1e-14
    ps = [k / 997 for k in range(1, 997)] + [1e-9, 1e-50, 1e-300, 1 - 1e-12]
    for r in spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal.ppf(F.col("p")).alias("z")).collect():
        assert abs(r["z"] - n.inv_cdf(r["p"])) <= 1e-13 * max(1, abs(r["z"]))
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-float("inf"),), (0.0,), (1.0,), (2.0,)], "x double")
    got = [tuple(r) for r in odd.select(normal.cdf(F.col("x")).alias("c"), normal.ppf(F.col("x")).alias("z")).collect()]
    assert got[0] == (None, None) and math.isnan(got[1][0]) and math.isnan(got[1][1]) and got[2][0] == 1 and got[3][0] == 0
    assert got[4] == (0.5, -math.inf) and got[5][1] == math.inf and math.isnan(got[6][1])


def test_convergence_takes_the_worst_series(spark):
    rows = [(c, n, k, float(k % 2) + (5.0 * (k < 50) if (c, n) == (1, "b") else 0.0)) for c in (0, 1) for n in "ab" for k in range(400)]
    zs = posterior.geweke(spark.createDataFrame(rows, "chain int, name string, at int, value double"), keys=("chain", "name"))
    got = {r["chain"]: r["converged"] for r in posterior.converged(zs).collect()}
    assert got == {0: True, 1: False}


@pytest.mark.parametrize("tile,block,group", [(4, 8, 1), (64, 1024, 64)])
def test_tiles_of_products(spark, tile, block, group):
    rng = np.random.default_rng(tile)
    x = rng.integers(0, 3, (70, 23)) * (rng.random((70, 23)) < 0.3)
    long = spark.createDataFrame([(s, c, float(x[s, c])) for s in range(70) for c in range(23) if x[s, c]], "sample_idx int, column int, value double")
    want = x.T @ x
    got = gram.tile_entries(gram.gram_tiles(long, tile, block, group), tile).collect()
    assert len(got) == len({(r["i"], r["j"]) for r in got})
    assert {(r["i"], r["j"]): r["xy"] for r in got} == {(i, j): want[i, j] for i in range(23) for j in range(i, 23) if want[i, j]}
    assert gram.gram_tiles(long.where("false"), tile).collect() == []


def test_resumed_chains_draw_what_unbroken_ones_draw(spark, tmp_path):
    _, _, design, phenotype = study(spark, n=120)
    short = sampler.Settings(burn_in=150, keep=400, slide=100, max_iter=700, seed=5, z_limit=0.9)
    numbered = design.select("hap_ord").distinct().withColumn("block_no", F.expr("hap_ord div 3"))
    args = (design, phenotype, tables.intercept(phenotype), numbered)
    folder = str(tmp_path / "run")
    assert run_log.run_log(spark, folder).count() == 0
    assert run_log.sample_in_jobs(*args, folder, chains=2, settings=short, steps=190, most_jobs=2) is None  # stopped here
    log = run_log.run_log(spark, folder)
    assert sorted((r["chain"], r["job"], r["steps"], r["done"]) for r in log.collect()) == [(c, j, 190 * (j + 1), False) for c in (0, 1) for j in (0, 1)]
    (tmp_path / "run" / "job-00001" / "_SUCCESS").unlink()  # as if the second job had been lost
    got = run_log.sample_in_jobs(*args, folder, chains=2, settings=short, steps=190).orderBy("chain", "segment").collect()
    want = sampler.sample(*args, chains=2, settings=short).orderBy("chain", "segment").collect()
    assert len(got) == len(want) == 8
    for a, b in zip(got, want):  # products of the samples are added up in any order, so the last digits may differ
        assert all(x == y if isinstance(x, (bool, int)) else np.allclose(np.array(x), np.array(y), rtol=1e-7) for x, y in zip(a, b))
    ended = {r["chain"]: r["steps"] for r in run_log.run_log(spark, folder).where("done").collect()}
    assert ended == {r["chain"]: r["steps"] for r in want}


@pytest.mark.parametrize("piece,alphabet", [(3, "01"), (8, "0129")])
def test_kth_neighbours_against_all_pairs(spark, piece, alphabet):
    rng = random.Random(piece)
    blocks_of = {("x", n): {"".join(rng.choice(alphabet) for _ in range(length)) for _ in range(count)} for n, (length, count) in enumerate([(9, 30), (5, 4), (70, 25), (3, 1), (0, 1)])}
    rows = [(c, n, a) for (c, n), own in blocks_of.items() for a in own]
    got = {(r["chrom"], r["block_ord"], r["alleles"]): (r["k"], r["distance"]) for r in neighbours.kth_neighbour(spark.createDataFrame(rows, "chrom string, block_ord int, alleles string"), 3, 2, piece).collect()}
    want = {}
    for (c, n), own in blocks_of.items():
        k = min(max(len(own) // 3, 2), len(own) - 1)
        for a in own if k else ():
            want[c, n, a] = (k, sorted(sum(x != y for x, y in zip(a, b)) for b in own if b != a)[k - 1])
    assert got == want
