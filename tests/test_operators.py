import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import posterior
from strandloom.operators import bigld, blocks, clustering, gram, haplotypes, ld, sampler
from strandloom.operators import variants as v
from strandloom.plans import jobs, queries
from strandloom.sources import sinks, tables
from strandloom.sources.variants import read_vcf

HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(f"s{k}" for k in range(4)) + "\n"


def vcf(path, rows):
    path.write_text(HEAD + "".join(f"{c}\t{p}\t{i}\tA\tG\t.\t.\t.\tGT\t" + "\t".join(g) + "\n" for c, p, i, g in rows))
    return str(path)


def test_vcf_orders_chromosomes_and_variants(spark, tmp_path):
    path = vcf(tmp_path / "a.vcf", [("2", 5, ".", ["0|1", "1|1", "0|0", "1|0"]), ("2", 9, ".", ["0|1:9", "1|1", "0|0", "1|0"]), ("1", 3, "x", ["1|1"] * 4)])
    rows = {(r["chrom"], r["var_idx"]): r for r in read_vcf(spark, path).collect()}
    assert rows["2", 0]["hap1"] == [0, 1, 0, 1] and rows["2", 0]["hap2"] == [1, 1, 0, 0]
    assert rows["2", 1]["chrom_ord"] == 0 and rows["1", 0]["chrom_ord"] == 1 and rows["2", 1]["pos"] == 9


@pytest.mark.parametrize("bad", ["0/1", ".|.", "10|2"])
def test_vcf_bad_genotypes(spark, tmp_path, bad):
    path = vcf(tmp_path / "b.vcf", [("1", 1, "a", ["0|1", bad, "0|0", "1|0"]), ("1", 2, "b", ["0|1"] * 4)])
    with pytest.raises(Exception, match="not phased"):
        read_vcf(spark, path).collect()
    assert [r["var_id"] for r in read_vcf(spark, path, missing="drop_variant").collect()] == ["b"]


def test_vcf_needs_a_header(spark, tmp_path):
    (tmp_path / "c.vcf").write_text("##only meta\n")
    with pytest.raises(ValueError):
        read_vcf(spark, str(tmp_path / "c.vcf"))


def merged_singletons(parts):
    """Sequential model: leading singletons join the first longer block."""
    out = []
    for left, right in parts:
        if out and (left == right or all(a == b for a, b in parts[: parts.index((left, right))])):
            out[-1] = (out[-1][0], right)
        else:
            out.append((left, right))
    return out


def merged_narrow(parts, width, keep=()):
    out, held = [], None
    for left, right in parts:
        if held is not None:
            left, held = held, None
        if not out:
            if right - left < width:
                held = left
                continue
            out.append([left, right])
        elif right - left < width and not (left in keep or right in keep):
            out[-1][1] = right
        else:
            out.append([left, right])
    return [tuple(x) for x in out] if held is None else [tuple(x) for x in out] + [(held, parts[-1][1])]


@pytest.mark.parametrize("seed", range(3))
def test_merges_follow_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    chroms = {}
    for c in range(25):
        sizes = [rng.choice([1, 1, 2, 3, 8, 12, 30]) for _ in range(rng.randint(1, 12))] + [rng.choice([11, 25])]
        ends = np.cumsum(sizes).tolist()
        chroms[str(c)] = [(e - s, e - 1) for s, e in zip(sizes, ends)]
    rows = [(c, a, b) for c, parts in chroms.items() for a, b in parts]
    common = spark.createDataFrame(rows, "chrom string, left_c int, right_c int")
    full = spark.createDataFrame(rows, "chrom string, left_idx int, right_idx int")

    def got(df, left, right):
        out = {}
        for r in df.orderBy("chrom", left).collect():
            out.setdefault(r["chrom"], []).append((r[left], r[right]))
        return out

    assert got(ld.merge_singletons(common), "left_c", "right_c") == {c: merged_singletons(p) for c, p in chroms.items()}
    assert got(blocks.merge_narrow(full), "left_idx", "right_idx") == {c: merged_narrow(p, 10) for c, p in chroms.items()}


def test_single_block_keeps_rare_ends(spark):
    parts = spark.createDataFrame([("1", 0, 1)], "chrom string, left_c int, right_c int")
    index = spark.createDataFrame([("1", 0, 2), ("1", 1, 4)], "chrom string, c_idx int, var_idx int")
    last = spark.createDataFrame([("1", 9)], "chrom string, last_idx int")
    assert [tuple(r) for r in blocks.to_full_index(parts, index, last).collect()] == [("1", 0, 9)]


def test_ld_edges_against_numpy_over_tiles(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, (60, 40))
    x[10] = 1
    rows = [("1", k, x[k].tolist()) for k in range(60)]
    common = spark.createDataFrame(rows, "chrom string, c_idx int, dosage array<int>")
    got = {(r["i"], r["j"]): r["r2"] for r in ld.ld_edges(common, 0.02, 7, tile=8).collect()}
    with np.errstate(invalid="ignore"):
        c = np.nan_to_num(np.corrcoef(x) ** 2)
    want = {(i, j): c[i, j] for i in range(60) for j in range(i + 1, min(i + 8, 60)) if c[i, j] > 0.02}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_ranks_two_one_and_many_clusters(spark):
    doses = spark.createDataFrame(
        [("1", 0, s, c, 1) for s, c in ((0, 0), (1, 0), (2, 1))] + [("1", 1, 0, 0, 2)] + [("1", 2, s, c, 1) for s, c in ((0, 0), (1, 0), (2, 1), (3, 2))],
        "chrom string, block_ord int, sample_idx int, cluster int, dose int",
    )
    kept = {(r["block_ord"], r["cluster"]): r["rank"] for r in haplotypes.rank_clusters(doses).where("kept").collect()}
    assert kept == {(0, 1): 1, (2, 2): 1, (2, 0): 2}


def test_clusterers_find_two_far_groups():
    rng = np.random.default_rng(0)
    a = np.zeros((12, 20))
    a[:6, :12] = 1
    a[np.arange(12), 12 + np.arange(12) % 8] = 1
    a = np.unique(a, axis=0)
    for name in ("xmeans", "KNN", "local", "modularity", "spectral", "affinity_propagation"):
        labels = clustering.CLUSTERERS[name](a, rng)
        sides = a[:, 0] == 1
        assert not set(labels[sides]) & set(labels[~sides]), name
    with pytest.raises(ValueError):
        clustering.cluster_haplotypes(None, "no such thing")


def test_gmeans_splits_past_thirty_groups():
    bits = lambda n, m: [[int(b) for b in format(k, f"0{m}b")] for k in range(n)]
    base = np.repeat(np.array(bits(64, 6)), [48, 40, 32, 24, 16, 12], axis=1)
    x = np.array([list(b) + n for b in base for n in bits(16, 4)], dtype=float)
    labels, groups = clustering.gmeans(x, np.random.default_rng(1)), np.repeat(np.arange(64), 16)
    assert all(len(set(groups[labels == c].tolist())) == 1 for c in set(labels.tolist()))
    spread = lambda starts: [
        np.square(x - centers[own]).sum()
        for own, centers in (clustering._best_kmeans(x, 6, np.random.default_rng(k), starts) for k in range(5))
    ]
    assert all(ten <= one for ten, one in zip(spread(10), spread(1)))


def test_geweke_of_constant_and_shifted_series(spark):
    rows = [(0, k, 1.0) for k in range(200)] + [(1, k, float(k % 7)) for k in range(200)]
    z = posterior.geweke(spark.createDataFrame(rows, "chain int, at int, value double")).collect()
    assert all(r["z"] == 0 for r in z if r["chain"] == 0) and all(abs(r["z"]) < 1 for r in z if r["chain"] == 1)
    series = np.array([float(k % 7) for k in range(200)])
    assert abs(sampler.geweke_max(series) - max(abs(r["z"]) for r in z if r["chain"] == 1)) < 1e-9
    assert sampler.geweke_max(np.ones(100)) == 0


def test_geweke_refuses_parts_that_overlap():
    for parts in ((0.0, 0.5), (0.1, 1.0), (0.6, 0.5)):
        with pytest.raises(ValueError):
            sampler.geweke_max(np.arange(50.0), *parts)


@pytest.mark.parametrize("seed", range(4))
def test_ward_merges_what_raises_the_spread_least(seed):
    x = np.random.default_rng(seed).normal(size=(11, 3))
    groups = [[k] for k in range(11)]
    spread = lambda g: np.square(x[g] - x[g].mean(axis=0)).sum()
    for k in range(10, 1, -1):
        a, b = min(((a, b) for a in range(len(groups)) for b in range(a)), key=lambda p: spread(groups[p[0]] + groups[p[1]]) - spread(groups[p[0]]) - spread(groups[p[1]]))
        groups = [g for n, g in enumerate(groups) if n not in (a, b)] + [groups[a] + groups[b]]
        labels = clustering.ward(x, k)
        assert {frozenset(np.flatnonzero(labels == c).tolist()) for c in set(labels.tolist())} == {frozenset(g) for g in groups}


@pytest.mark.parametrize("seed", range(4))
def test_kmeans_stops_where_nothing_moves(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 2, (40, 9)).astype(float)
    labels, centers = clustering._kmeans(x, 4, rng)
    assert all(np.allclose(centers[c], x[labels == c].mean(axis=0)) for c in set(labels.tolist()))
    own = np.square(x - centers[labels]).sum(axis=1)
    assert (own <= np.square(x[:, None] - centers[None]).sum(axis=2).min(axis=1) + 1e-9).all()


def brute_stretches(x, reach):
    strong = np.abs(np.corrcoef(x)) > 0.5
    out = set()
    for i in range(len(x)):
        for j in np.flatnonzero(strong[i, i + 1 : i + 1 + reach]) + i + 1:
            near = np.triu(strong[i : j + 1, i : j + 1], 1) & ~np.triu(np.ones((j - i + 1,) * 2, dtype=bool), reach + 1)
            if near.sum() >= (j - i + 1) * (j - i) / 4:
                out.add((i, int(j)))
    return out


def brute_choice(stretches, m):
    """The greatest weight of disjoint stretches, end by end."""
    best = [0]
    for e in range(m):
        best.append(max([best[e]] + [best[i] + (e - i + 1) * bigld.UNIT + e - i for i, j in stretches if j == e]))
    return best[m]


@pytest.mark.parametrize("reach", [5, None])
def test_stretches_and_their_choice_against_the_square(spark, reach):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (12, 80))[np.repeat(np.arange(12), 9)] ^ (rng.random((108, 80)) < 0.1)
    common = spark.createDataFrame([("1", k, x[k].tolist()) for k in range(108)], "chrom string, c_idx int, dosage array<int>")
    whole = spark.createDataFrame([("1", 0, 107)], "chrom string, left_c int, right_c int")
    links, placed = bigld.block_links(common, whole, 0.5, reach)
    assert placed.count() == 108
    stretches = bigld.dense_stretches(links)
    want = brute_stretches(x, reach or 107)
    assert {(r["i"], r["j"]) for r in stretches.collect()} == want and len(want) > 100
    picked = sorted((r["i"], r["j"]) for r in bigld.best_disjoint(stretches).collect())
    assert all(a[1] < b[0] for a, b in zip(picked, picked[1:])) and set(picked) <= want
    assert sum((j - i + 1) * bigld.UNIT + j - i for i, j in picked) == brute_choice(want, 108)
    alone = bigld.bigld_like(common, spark.createDataFrame([("1", 0, 40), ("1", 41, 107)], "chrom string, left_c int, right_c int"), 2.0, reach)
    assert sorted((r["left_c"], r["right_c"]) for r in alone.collect()) == [(0, 40), (41, 107)]


@pytest.mark.parametrize("reach", [3, None])
def test_reach_bounds_the_blocks_of_cliques(spark, reach):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 3, 80)
    x = np.array([np.where(rng.random(80) < 0.02, rng.integers(0, 3, 80), base) for _ in range(12)])
    common = spark.createDataFrame([("1", k, x[k].tolist()) for k in range(12)], "chrom string, c_idx int, dosage array<int>")
    whole = spark.createDataFrame([("1", 0, 11)], "chrom string, left_c int, right_c int")
    got = sorted((r["left_c"], r["right_c"]) for r in bigld.bigld_like(common, whole, 0.5, reach).collect())
    assert got == ([(0, 11)] if reach is None else [(0, 3), (4, 7), (8, 11)])


def test_lines_are_numbered_in_file_order(spark, tmp_path):
    for k, lines in enumerate((["a"] * 3, [f"row {i} " + "x" * 50 for i in range(400)], ["z", "", "y"])):
        (tmp_path / f"part-{k}").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = sorted((r["n"], r["value"]) for r in tables.numbered_lines(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = ["a"] * 3 + [f"row {i} " + "x" * 50 for i in range(400)] + ["z", "y"]
    assert rows == list(enumerate(want))


def study(spark, n=300, p=12, seed=3):
    rng = np.random.default_rng(seed)
    h = rng.binomial(2, 0.3, (n, p))
    y = 1.2 * h[:, 2] - 1.0 * h[:, 7] + rng.normal(0, 1, n) + 0.5
    design = spark.createDataFrame(
        [(s, k, f"1@{k // 3}-{k // 3 + 1}_{k % 3 + 1}", int(h[s, k])) for s in range(n) for k in range(p) if h[s, k]],
        "sample_idx int, hap_ord int, hap_name string, dose int",
    )
    return h, y, design, spark.createDataFrame([(s, float(y[s])) for s in range(n)], "sample_idx int, y double")


def test_sampler_recovers_planted_effects(spark):
    h, y, design, phenotype = study(spark)
    settings = sampler.Settings(burn_in=300, keep=1000, slide=200, max_iter=2500, seed=5)
    result = jobs.map_effects(design, phenotype, chains=3, settings=settings)
    pip = {r["hap_ord"]: r["pip"] for r in result.haplotype_pip.collect()}
    assert pip[2] > 0.9 and pip[7] > 0.9 and all(x < 0.5 for k, x in pip.items() if k not in (2, 7))
    beta = {r["hap_ord"]: r["mean"] for r in result.beta.collect()}
    assert abs(beta[2] - 1.2) < 0.3 and abs(beta[7] + 1.0) < 0.3
    block = {r["block"]: r["pip"] for r in result.block_pip.collect()}
    assert block["1@0-1"] > 0.9 and block["1@2-3"] > 0.9


def collected(spark, design, phenotype, annotation=None):
    long = sampler.long_table(design, phenotype, tables.intercept(phenotype), 1)
    g = gram.gram(long).toArrow()
    size = 3 + design.agg(F.max("hap_ord")).first()[0] + 1
    dense = sampler.gram_statistics(gram.dense_matrix(*(g.column(c).to_numpy() for c in ("i", "j", "xy")), size), 1, annotation)
    rows = long.toArrow()
    return dense, sampler.SparseData(*(rows.column(c).to_numpy() for c in ("sample_idx", "column", "value")), 1, size, annotation)


def test_statistics_give_direct_residuals(spark):
    h, y, design, phenotype = study(spark)
    chain = sampler.Chain(collected(spark, design, phenotype)[0], sampler.Settings(seed=2), 0)
    for _ in range(30):
        chain.step()
    fit = h @ chain.beta
    residual = y - chain.alpha[0] - fit
    assert abs(chain.rss() - residual @ residual) < 1e-6 * chain.rss()
    assert abs(chain.h2() - fit.var() / (y - chain.alpha[0]).var()) < 1e-9
    assert np.allclose(chain.rh, h.T @ residual) and np.allclose(chain.rc, residual.sum())


def test_sparse_columns_draw_what_sums_draw(spark):
    _, _, design, phenotype = study(spark)
    annotation = np.column_stack([np.ones(12), np.arange(12) % 2])
    for extra in (None, annotation):
        one, two = (kind(data, sampler.Settings(seed=2), 0) for kind, data in zip((sampler.Chain, sampler.SparseChain), collected(spark, design, phenotype, extra)))
        for step in range(60):
            one.step()
            two.step()
            if step == 30:
                one.refresh(), two.refresh()
            assert np.allclose(one.beta, two.beta) and np.allclose(one.alpha, two.alpha) and (one.gamma == two.gamma).all()
            assert abs(one.h2() - two.h2()) < 1e-9 and abs(one.sigma_e - two.sigma_e) < 1e-9


def test_many_columns_take_the_sparse_way(spark):
    _, _, design, phenotype = study(spark)
    short = dict(burn_in=100, keep=400, slide=100, max_iter=700, seed=5)
    results = [jobs.map_effects(design, phenotype, chains=2, settings=sampler.Settings(**short, gram_columns=limit)) for limit in (4096, 3)]
    pips = [[(r["hap_ord"], round(r["pip"], 9), round(r["n_converged"])) for r in x.haplotype_pip.orderBy("hap_ord").collect()] for x in results]
    assert pips[0] == pips[1] and len(pips[0]) == 12
    log = results[0].chains.collect()
    assert all(r["kept"] == 400 and 500 <= r["steps"] <= 700 and len(r["worst_z"]) >= 1 for r in log)
    none = jobs.map_effects(design, phenotype, chains=1, settings=sampler.Settings(**short, z_limit=0.0), only_converged=True)
    assert none.haplotype_pip.count() == 0 and not none.chains.first()["converged"]


def test_gram_of_tiles_equals_the_dense_product(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 3, (70, 23)) * (rng.random((70, 23)) < 0.3)
    long = spark.createDataFrame([(s, c, float(x[s, c])) for s in range(70) for c in range(23) if x[s, c]], "sample_idx int, column int, value double")
    for numbers in (1 << 24, 40):
        got = {(r["i"], r["j"]): r["xy"] for r in gram.gram(long, tile=4, slice_numbers=numbers).collect()}
        want = x.T @ x
        assert got == {(i, j): want[i, j] for i in range(23) for j in range(i, 23) if want[i, j]}


def test_text_round_trips(spark, tmp_path):
    _, _, design, phenotype = study(spark, n=20)
    samples = phenotype.select("sample_idx")
    sinks.write_design(design, samples, str(tmp_path / "dm"))
    back = tables.read_design(spark, str(tmp_path / "dm")).where("dose > 0")
    key = lambda df: sorted((r["sample_idx"], r["hap_name"], r["dose"]) for r in df.collect())
    assert key(back) == key(design)
    parts = spark.createDataFrame([("1", 0, 0, 4), ("1", 1, 5, 9)], "chrom string, block_ord int, left_idx int, right_idx int")
    sinks.write_partition(parts, str(tmp_path / "p"))
    assert sorted(map(tuple, tables.read_partition(spark, str(tmp_path / "p")).collect())) == sorted(map(tuple, parts.collect()))


def test_whole_job_on_a_vcf(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows, base = [], rng.integers(0, 2, (4, 2, 40))
    head = HEAD.strip("\n").rsplit("\t", 4)[0] + "\t" + "\t".join(f"s{k}" for k in range(40)) + "\n"
    for k in range(32):
        g = base[k // 8] ^ (rng.random((2, 40)) < 0.05)
        rows.append(f"1\t{100 * k}\tv{k}\tA\tG\t.\t.\t.\tGT\t" + "\t".join(f"{a}|{b}" for a, b in zip(*g.astype(int))))
    path = tmp_path / "j.vcf"
    path.write_text(head + "\n".join(rows) + "\n")
    result = jobs.haplotype_design(read_vcf(spark, str(path)))
    tiles = sorted((r["left_idx"], r["right_idx"]) for r in result.fine.collect())
    assert tiles[0][0] == 0 and tiles[-1][1] == 31 and all(a[1] + 1 == b[0] for a, b in zip(tiles, tiles[1:]))
    assert result.design.agg(F.max("dose")).first()[0] <= 2
    common = v.common_variants(read_vcf(spark, str(path)))
    assert common.count() <= 32


def test_effects_make_a_design_no_more_than_twice(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [(s, h, f"1@100-{200 + h // 3}_{h % 3}", 1 + (s + h) % 2) for s in range(40) for h in range(6) if (s * 7 + h * 3) % 5 < 3]
    source = spark.createDataFrame(rows, "sample_idx int, hap_ord int, hap_name string, dose int")
    design = source.mapInArrow(counted, source.schema)
    phenotype = spark.range(40).select(F.col("id").cast("int").alias("sample_idx"), F.sin("id").alias("y"))
    settings = sampler.Settings(burn_in=20, keep=60, slide=20, max_iter=200)
    result = jobs.map_effects(design, phenotype, chains=2, settings=settings)
    assert result.haplotype_pip.count() == result.beta.count() == 6 and result.block_pip.count() == 2
    assert made.value <= 2 * len(rows)


def test_the_simulated_study_is_made_once(spark, sf_dir):
    design, phenotype, _ = queries.simulated_study(spark, sf_dir)
    for df, name in ((design, "design"), (phenotype, "phenotype")):
        assert df.inputFiles() and all(f"/{name}-" in x for x in df.inputFiles())
