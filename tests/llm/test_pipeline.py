import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from strandloom.llm import shared, toxicity
from tests.llm.test_operators import brute_components, thue_morse, words

#: Names that operators give their own columns, and awkward ones.
COLUMNS = (
    "doc_id long, text string, lang string, n_chars long, n_lines int, n_removed int, n_words int, n_hit int, items string, "
    "contaminated int, score double, component_id int, n_shingles int, `row` int, row_ int, row__ int, rest int, `a.b` int, hash int, spots int"
)


def table(spark, rows):
    """Rows of ``doc_id, text`` with all the other columns filled."""
    full = [(d, t, "en", None if t is None else len(t), *range(6), 0.5, *range(9)) for d, t in rows]
    return spark.createDataFrame([(*r[:8], "i", *r[9:]) for r in full], COLUMNS)


def folder(spark, path, labels=(), bench=()):
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(bench), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def check_rest(docs, kept):
    """Kept rows have the columns of the input, unchanged but for text and n_chars."""
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    mine = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    rows = [r.asDict() for r in kept.collect()]
    one = docs.limit(1).collect()
    assert all(r[c] == one[0][c] for r in rows for c in mine)
    return rows


def bare(rows):
    return sorted(((r["doc_id"], r["text"]) for r in rows), key=repr)


ODD_ROWS = [(1, None), (2, ""), (3, "  \n "), (None, "alone here"), (None, None), (4, "x" * 50_000)]


def test_toxicity_stage(spark, tmp_path):
    rows, labels = list(ODD_ROWS), []
    for k in range(100, 700):
        toxic = k % 5 == 0
        rows.append((k, " ".join([*words(20, k), *(["snarfel"] if toxic else []), *words(9, 5000 + k)])))
        labels.append((k, 1, int(toxic)))
    rows += [(101, "you snarfel"), (101, "fine again")]
    docs, sf_dir = table(spark, rows), folder(spark, tmp_path, labels)
    kept = check_rest(docs, corpus_pipeline.drop_toxic(spark, docs, sf_dir))
    want = bare([{"doc_id": d, "text": t} for d, t in rows if "snarfel" not in (t or "")])
    assert bare(kept) == want
    scores = {r["doc_id"]: r for r in toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    held = [k for k in range(100, 700) if zlib.crc32(str(k).encode()) % 4 == 2 and k != 101]
    assert len(held) > 100 and all(scores[k]["predicted"] == (k % 5 == 0) for k in held)
    assert corpus_pipeline.drop_toxic(spark, docs.where("false"), sf_dir).count() == 0


def brute_lines(rows):
    """Lines that each row loses, by (doc_id, line) of the first place of each window of three."""
    first, windows = {}, []
    for d, t in rows:
        full = [(k, x.strip(" ")) for k, x in enumerate((t or "").split("\n")) if x.strip(" ")]
        own = [(tuple(x for _, x in full[s : s + 3]), s, [k for k, _ in full[s : s + 3]]) for s in range(len(full) - 2)]
        windows.append(own)
        for w, s, _ in own if d is not None else []:
            first[w] = min(first.get(w, (d, s)), (d, s))
    out = []
    for (d, t), own in zip(rows, windows):
        gone = {k for w, s, at in own if d is not None and first[w] != (d, s) for k in at}
        out.append((d, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone) if gone else t))
    return out


def test_line_stage(spark, tmp_path):
    rng, rows = np.random.default_rng(4), list(ODD_ROWS)
    for d in (*range(10, 40), 20, 20, 21, None):
        rows.append((d, "\n".join(rng.choice(["a", "b", " c", "", "long line " + str(rng.integers(3))], int(rng.integers(0, 12))))))
    rows += [(50, "u1\nu2\nu3"), (50, "a\na\na\na"), (50, "u1\nu2\nu3")]
    docs = table(spark, rows)
    kept = check_rest(docs, corpus_pipeline.cut_repeated_lines(spark, docs, str(tmp_path)))
    assert bare(kept) == sorted(brute_lines(rows), key=repr)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in kept)
    assert corpus_pipeline.cut_repeated_lines(spark, docs.where("false"), str(tmp_path)).count() == 0
    assert corpus_pipeline.cut_repeated_lines(spark, docs.select("doc_id", "text"), str(tmp_path)).columns == ["doc_id", "text"]


def test_near_copy_stage(spark, tmp_path):
    rng, rows = np.random.default_rng(9), list(ODD_ROWS)
    for family in range(4):
        base = words(int(rng.integers(40, 150)), family)
        for copy in range(7):
            own = list(base)
            for k in rng.integers(0, len(own), int(rng.integers(0, 5))):
                own[k] = f"n{family}-{copy}-{k}"
            rows.append((int(rng.integers(100, 400)), " ".join(own)))
    unique = " ".join(words(50, 99))
    one, two = thue_morse(2048)
    rows += [rows[-1], (rows[-1][0], unique), (7, unique + " more"), (None, unique), (60, f"{one} b c d e"), (61, f"{two} b c d e")]
    docs = table(spark, rows)
    kept = check_rest(docs, corpus_pipeline.keep_one_of_near_copies(spark, docs, str(tmp_path)))
    labels, want = brute_components([t for _, t in rows], 5, 80), {}
    for (d, t), (_, label) in zip(rows, labels):
        want.setdefault(label, []).append((d is None, d or 0, d, t))
    groups = [[(d, t) for none, key, d, t in g if (none, key) == min(x[:2] for x in g)] for g in want.values()]
    got = bare(kept)
    assert len(got) == len(groups)
    for group in groups:  # of rows of the smallest id any one may stay
        assert sum(x in got for x in set(group)) >= 1
    assert corpus_pipeline.keep_one_of_near_copies(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_decontamination_stage(spark, tmp_path):
    phrase = words(40, 5)
    item = " ".join(phrase)
    rows = [*ODD_ROWS, (10, item), (11, " ".join([*words(30, 6), *phrase[3:17]])), (12, " ".join([*words(900, 7), *phrase[:14]])), (12, "clean " + " ".join(words(30, 8)))]
    rows += [(13, " ".join(phrase[:12])), (13, item.upper()), (14, "Short, item!"), (None, item)]
    docs, sf_dir = table(spark, rows), folder(spark, tmp_path, bench=[(1, item), (2, "short item"), (3, None), (3, "")])

    def brute(text):
        cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        own, hit = cut(text), set()
        for x in (phrase, ["short", "item"]):
            size = min(13, len(x))
            runs = {tuple(x[k : k + size]) for k in range(len(x) - size + 1)}
            hit |= {k + j for k in range(len(own) - size + 1) if tuple(own[k : k + size]) in runs for j in range(size)}
        return bool(hit) and 20 * len(hit) >= len(own)

    kept = check_rest(docs, corpus_pipeline.drop_contaminated(spark, docs, sf_dir))
    assert bare(kept) == bare([{"doc_id": d, "text": t} for d, t in rows if not brute(t)])
    assert 0 < len(kept) < len(rows) and corpus_pipeline.drop_contaminated(spark, docs.where("false"), sf_dir).count() == 0


def test_packing_stage(spark, tmp_path):
    rows = [*ODD_ROWS, *[(k, " ".join(words(k, k))) for k in range(5, 200, 9)], (5, "same"), (5, "same")]
    pieces = corpus_pipeline.pack_sequences(spark, table(spark, rows), str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(((d, i) for d, t in rows for i in [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]), key=repr)
    assert sorted(((p["doc_id"], int(i)) for p in pieces for i in np.frombuffer(p["ids"], "<u4")), key=repr) == want
    assert corpus_pipeline.pack_sequences(spark, table(spark, rows).where("false"), str(tmp_path)).count() == 0


def test_stages_hand_on_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
    before = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir).cache()
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        assert kept.count() <= before
        docs, before = kept, kept.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    fill = {}
    for p in pieces:
        fill[p["sequence_id"]] = fill.get(p["sequence_id"], 0) + p["length"]
    sizes = np.array(list(fill.values()))
    assert ((sizes <= 1024) & ((sizes & (sizes - 1)) == 0)).all()


def test_run_equals_its_stages(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"] and rows.count() > 0


def test_near_copies_are_judged_by_five_words_and_four_fifths(spark, sf_dir):
    def replaced(base, places):
        return " ".join("other" + w if k in places else w for k, w in enumerate(base))

    one, two = ([f"{c}{k}" for k in range(100)] for c in "ab")
    # J5 = 86 / 106 = 0.81 and J3 = 92 / 104 = 0.88 for two words; J5 = 81 / 111 = 0.73 for three.
    texts = [" ".join(one), replaced(one, {30, 60}), " ".join(two), replaced(two, {20, 50, 80})]
    rows = [(k, t, "en", "web", len(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.keep_one_of_near_copies(spark, docs, sf_dir)
    assert sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2], rows[3]]


def shuffle_bytes(spark):
    """Bytes of all shuffle files on this machine, when no more of them go."""
    manager, before = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), None
    while True:
        files = manager.getAllFiles()
        now = sum(f.length() for f in (files.apply(k) for k in range(files.size())) if f.getName().startswith("shuffle_"))
        if now == before:
            return now
        before = now
        time.sleep(1)


@pytest.mark.parametrize("repeated", [False, True])
def test_near_copy_stage_does_not_shuffle_texts_without_copies(spark, tmp_path, repeated, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"{x:x}" for x in rng.integers(0, 1 << 40, 400)) for _ in range(500)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(500 + k, t + " more") for k, t in enumerate(texts[:20])]
    rows += [(499, texts[30])] if repeated else []  # numbers of its own for each row
    docs, size = table(spark, rows), sum(len(t) for _, t in rows)
    before = shuffle_bytes(spark)
    kept = corpus_pipeline.keep_one_of_near_copies(spark, docs, str(tmp_path))
    kept.write.parquet(f"{tmp_path}/kept")
    moved = shuffle_bytes(spark) - before
    want = sorted((k, t) for k, t in enumerate(texts))
    assert sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/kept").collect()) == want
    assert moved < size / 5
    monkeypatch.setattr(shared, "SENT_KEYS", -1)  # as where there are too many candidates to send
    kept = corpus_pipeline.keep_one_of_near_copies(spark, docs, str(tmp_path))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == want


def test_a_written_table_leaves_no_shuffle_files(spark):
    name, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", shuffle_bytes(spark)
    held = spark.conf.get(name, None)
    df = shared.write_table(spark.range(300_000).withColumn("u", F.expr("uuid()")).repartition(3, "id"), "moved")
    assert df.count() == 300_000 and spark.conf.get(name, None) == held
    assert shuffle_bytes(spark) - before < 1_000_000
