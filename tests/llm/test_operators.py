"""Operators against brute force, on small tables with every awkward kind of row."""

import hashlib
import math
import re
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandloom.llm import ann, chat_format, decontamination, licenses, line_dedup, ngram_join, packing, substring_dedup, token_store, toxicity
from strandloom.llm.components import connected_components
from strandloom.llm.hashing import WordHasher, run_hashes, run_starts
from strandloom.llm.queries import ORACLES, QUERIES
from strandloom.llm.unit_encoder import UnitEncoder
from tests.oracle import assert_same

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, n_words string, component_id string, score string"


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t, "x", "y", "z") for k, t in enumerate(texts)], DOCS)


def words(n, seed=0):
    rng = np.random.default_rng(seed)
    return [f"w{v}" for v in rng.integers(0, 5000, n)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), sf_dir, ORACLES[name])


ENCODERS = [(Tokenizer.from_file(path), UnitEncoder(path, space, cache_units=50)) for path, space in ((BYTE, True), (WORD, False))]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t.,'aAéÉ1Σß<|>\"-́ sS \u0085endoftx\x00\x01　!$ĠʼnİΆ"), max_size=40), max_size=6))
def test_unit_encoder_is_exact(texts):
    for tokenizer, encoder in ENCODERS:
        ids, counts = encoder.encode(texts)
        want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["word", "Wörd", "s", "A", ".", ",", "$$", "'", "'s", "1", "\n", "\n\n", " ", " ", " "]), max_size=20).map("".join), max_size=6))
def test_unit_encoder_is_exact_on_ordinary_texts(texts):
    test_unit_encoder_is_exact.hypothesis.inner_test(texts)


def test_special_strings_are_encoded_as_the_library_does():
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>y."]
    for path, space in ((BYTE, True), (WORD, False)):
        ids, _ = UnitEncoder(path, space).encode(texts)
        assert ids.tolist() == [i for t in texts for i in Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \né"), max_size=20), min_size=1, max_size=6), st.integers(1, 5))
def test_run_hashes_tell_runs_apart(texts, length):
    hashes, bounds = WordHasher().words(texts)
    split = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    assert np.diff(bounds).tolist() == [len(w) for w in split]
    runs = [tuple(w[k : k + length]) for w in split for k in range(len(w) - length + 1)]
    got = run_hashes(hashes, length)[run_starts(bounds, length)]
    assert len(got) == len(runs) and len(set(got.tolist())) == len(set(runs))
    assert len(set(zip(got.tolist(), runs))) == len(set(runs))


def brute_substring(texts, window):
    split, first = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts], {}
    out = []
    for d, w in enumerate(split):
        gone = set()
        for k in range(len(w) - window + 1):
            if first.setdefault(tuple(w[k : k + window]), (d, k)) != (d, k):
                gone |= set(range(k, k + window))
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_substring_dedup_against_brute_force(spark):
    base = words(400)
    texts = [" ".join(base), None, "", "  \n ", " ".join(base[50:120]), "z " * 90, " ".join(words(30, 1) + base[10:60] + words(30, 2)), " ".join(base), "é ü " * 3]
    texts += [" ".join(words(60, k) + base[100:125]) for k in range(3, 12)]
    df = docs_of(spark, texts).repartition(5)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in substring_dedup.substring_dedup(df, 20, width_log2=16, shard_windows=200).collect()}
    assert [got[k] for k in range(len(texts))] == brute_substring(texts, 20)


def test_sketch_never_underestimates():
    sketch = substring_dedup.TaskSketch(2, 10)
    rng = np.random.default_rng(0)
    values = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    sketch.add(np.concatenate([values, values[:100]]))
    sketch.add(values[100:150])
    for row in range(2):
        cells = substring_dedup._cells(values[:150], row, 10)
        assert substring_dedup._bits(sketch.repeated[row], cells).all()


def test_decontamination_edges(spark):
    phrase = words(40, 5)
    bench = spark.createDataFrame([(1, " ".join(phrase)), (2, None), (3, ""), (10, "W1 w2, w3"), (11, "W1 w2, w3"), (4, "alone")], "item_id long, text string")
    texts = [" ".join(words(50, 6) + phrase[5:25] + words(10, 7)), "w1 W2 w3", None, "", "...", " ".join(phrase[:12]), "x " * 900 + "alone", "Éalone"]
    found = decontamination.contamination(docs_of(spark, texts), bench)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in found.collect()}
    assert got[0] == (80, 20, ["1"], True) and got[1] == (3, 3, ["10", "11"], True)
    assert all(got[k] == (0, 0, [], False) for k in (2, 3, 4)) and got[5] == (12, 0, [], False)
    assert got[6] == (901, 1, ["4"], False) and got[7] == (1, 0, [], False)
    empty = bench.where("false")
    assert decontamination.contamination(docs_of(spark, texts), empty).where("contaminated").count() == 0
    assert decontamination.contamination(docs_of(spark, texts).where("false"), bench).count() == 0


def test_proximity_matches(spark):
    tokens = spark.createDataFrame([(1, "a x x b".split()), (2, "a x x x x x b".split()), (3, "b a".split())], "row long, terms array<string>")
    terms = spark.createDataFrame([(0, "a"), (0, "b")], "item long, term string")
    index = decontamination.build_index(tokens, terms)
    assert {(r["row"], r["position"]) for r in decontamination.proximity_matches(index, terms, 4).collect()} == {(1, 0), (3, 0)}


def test_rows_of_one_id_and_of_none_are_judged_by_their_own_words(spark):
    bench = spark.createDataFrame([(7, "alpha beta"), (8, "gamma gamma"), (9, "delta")], "item_id long, text string")
    rows = [(1, "alpha one two"), (1, "three beta"), (1, "beta x x alpha"), (None, "alpha beta"), (None, "alpha"), (None, "beta"), (2, "gamma x gamma"), (3, "delta"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontamination.contamination(docs, bench, within=4, keep=("text",)).collect()
    got = {(r["doc_id"], r["text"]): (r["n_hit"], r["items"], r["near_items"]) for r in found}
    assert len(found) == len(rows) and got == {
        (1, "alpha one two"): (0, [], []), (1, "three beta"): (0, [], []), (1, "beta x x alpha"): (0, [], ["7"]), (None, "alpha beta"): (2, ["7"], ["7"]),
        (None, "alpha"): (0, [], []), (None, "beta"): (0, [], []), (2, "gamma x gamma"): (0, [], ["8"]), (3, "delta"): (1, ["9"], ["9"]), (3, None): (0, [], []),
    }


@pytest.mark.parametrize("within", [1, 2, 5])
def test_lists_that_come_close(spark, within):
    rng = np.random.default_rng(within)
    rows = [tuple(sorted(rng.choice(60, n, replace=False).tolist()) for n in rng.integers(1, 7, 2)) for _ in range(80)]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>")
    for r in df.select("a", "b", decontamination.close_together(F.col("a"), F.col("b"), within).alias("near")).collect():
        assert r["near"] == any(abs(x - y) < within for x in r["a"] for y in r["b"])


def test_lines_of_one_id_are_cut_at_their_own_places(spark):
    rows = [(1, "a\nb\nc"), (5, "a\nb\nc"), (5, "v1\nv2\nv3"), (5, "v1\nv2\nv3"), (None, "a\nb\nc")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"], r["text"]) for r in line_dedup.line_dedup(df).collect())
    assert got == [(0, 0, "a\nb\nc"), (1, 0, "a\nb\nc"), (5, 0, "v1\nv2\nv3"), (5, 0, "v1\nv2\nv3"), (5, 3, "")]


def test_line_dedup_edges(spark):
    block = "one\n two \nthree\nfour"
    texts = [block, None, "", "one\ntwo\n\nthree", "a\nb", "k\n" * 5, "x\n" + block + "\ny", block.upper(), "\n\n\n\n"]
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.line_dedup(docs_of(spark, texts)).collect()}
    assert got[0] == (4, 0, block) and got[1] == (0, 0, None) and got[2] == (0, 0, "")
    assert got[3] == (3, 3, "") and got[4][1] == 0 and got[5] == (5, 4, "k\n")
    assert got[6] == (6, 4, "x\ny") and got[7][1] == 0 and got[8] == (0, 0, "\n\n\n\n")
    assert line_dedup.line_dedup(docs_of(spark, texts).where("false")).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=40))
def test_first_fit_decreasing_against_a_scan(sizes):
    bins, want = packing.first_fit_decreasing(sizes, 64), []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        for b in want:
            if sum(sizes[x] for x in b) + sizes[k] <= 64:
                b.append(k)
                break
        else:
            want.append([k])
    assert bins == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=30))
def test_packing_places_every_id_once_without_padding(sizes):
    seen = Counter()
    for pieces in packing.pack_rows(sizes, 64):
        total = sum(p[2] for p in pieces)
        assert 0 < total <= 64 and (total & (total - 1)) == 0
        for row, start, length in pieces:
            seen.update((row, k) for k in range(start, start + length))
    assert seen == Counter((r, k) for r, n in enumerate(sizes) for k in range(n))


def test_pack_rebuilds_all_documents(spark):
    texts = ["hello world, " * 700, None, "", "A\n\n b <|endoftext|>", "été " * 50, "same", "same"]
    rows = packing.pack(docs_of(spark, texts), BYTE, capacity=64, group_rows=2).collect()
    tokenizer = Tokenizer.from_file(BYTE)
    for k, text in enumerate(texts):
        own = sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["start"])
        ids = np.frombuffer(b"".join(bytes(r["ids"]) for r in own), "<u4").tolist()
        assert ids == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        assert [r["start"] for r in own] == [sum(r["length"] for r in own[:j]) for j in range(len(own))]
    for number in {r["sequence_id"] for r in rows}:
        own = sorted((r for r in rows if r["sequence_id"] == number), key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(r["length"] for r in own[:j]) for j in range(len(own))]
    assert packing.pack(docs_of(spark, texts).where("false"), BYTE).count() == 0


def group_rows(pieces):
    """Rows of pieces in each packing group, and ids."""
    rows, ids = Counter(), Counter()
    for p in pieces:
        rows[p["sequence_id"] >> 32] += 1
        ids[p["sequence_id"] >> 32] += p["length"]
    return rows, ids


def test_pack_spreads_huge_and_equal_documents(spark):
    huge = packing.pack(docs_of(spark, ["a b " * 20_000] * 5), BYTE, capacity=16, group_rows=64).collect()
    rows, ids = group_rows(huge)
    assert sum(ids.values()) == 5 * (40_001 + 1) and len(rows) >= 3 and max(ids.values()) < 2 * sum(ids.values()) / len(ids)
    by_ids, _ = group_rows(packing.pack(docs_of(spark, ["a b " * 20_000] * 5), BYTE, capacity=16, group_ids=4096).collect())
    assert len(by_ids) > 20
    equal = docs_of(spark, ["same"]).select(F.explode(F.array_repeat(F.lit(7).cast("long"), 600)).alias("doc_id"), "text")
    rows, ids = group_rows(packing.pack(equal.withColumn("doc_id", F.lit(None).cast("long")), BYTE, capacity=16, group_rows=50).collect())
    assert sum(ids.values()) == 1200 and len(rows) >= 10 and max(rows.values()) < 200


def test_token_store_cuts_equal_ids_into_several_parts(spark, tmp_path):
    docs = spark.range(4000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text")).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_store.write_store(docs, str(tmp_path / "s"), WORD, False, end_id=2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(str(tmp_path / "s")).select("part").distinct().count() > 1
    rows = sorted((r["start"], r["n_tokens"]) for r in token_store.read_store(spark, str(tmp_path / "s")).collect())
    assert len(rows) == 4000 and all(a[0] + a[1] == b[0] for a, b in zip(rows, rows[1:]))


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(2)
    texts, labels = [], []
    for k in range(600):
        toxic = k % 5 == 0
        body = words(30, 100 + k)
        if toxic:
            body.insert(int(rng.integers(0, 29)), "snarfel" + rng.choice(["", "s", "ing"]))
        texts.append(" ".join(body) + ". " + " ".join(words(10, 900 + k)) if k != 7 else None)
        labels.append((k, 1, int(toxic)))
    docs = docs_of(spark, texts)
    table = spark.createDataFrame(labels + [(9999, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(docs, table).collect()
    assert len(rows) == 600 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(r["predicted"] == (r["doc_id"] % 5 == 0) for r in rows if r["held_out"])
    assert toxicity.drop_toxic(docs, table).columns == docs.columns and toxicity.drop_toxic(docs, table).count() == 480
    none = toxicity.toxicity(docs, table.where("false"))
    assert none.where("predicted = 1").count() == 0 and toxicity.toxicity(docs.where("false"), table).count() == 0


def test_grammar_contexts():
    grammar = toxicity.ClauseGrammar()
    run = lambda *kinds: [x[:2] for x in grammar.run([(k, 1.0) for k in kinds])]
    I, K, N, R, T, S, W, O = (getattr(toxicity, x) for x in "INSULT THREAT NEGATION REPORT TARGET SPEAKER FUTURE OTHER".split())
    assert run(O, I) == [("insult-bare", "plain")] and run(N, O, I) == [("insult-bare", "negated")]
    assert run(N, O, O, O, I) == [("insult-bare", "plain")] and run(R, O, O, I) == [("insult-bare", "reported")]
    assert run(T, O, I) == [("insult-aimed", "plain"), ("", "targeted")] and run(T, O, O, O, I)[0] == ("insult-bare", "plain")
    assert run(I, I) == [("insult-bare", "plain"), ("insult-chained", "plain")]
    assert run(K) == [("threat-bare", "plain")] and run(S, W, O, K) == [("threat-announced", "plain")]
    assert run(S, N, W, K, O, T) == [("threat-announced", "negated"), ("threat-aimed", "plain"), ("", "targeted")]
    assert run(S, O, O, O, O, W, K) == [("threat-bare", "plain")] and run(K, O, O, O, T)[:1] == [("threat-bare", "plain")]
    assert run(O, O) == [] and run(T, S, W) == []
    weights = [x[2] for x in grammar.run([(T, 0.0), (I, 2.0), (I, 4.0)])]
    assert weights == [3.0, 5.0, 8.0]


def test_scores_depend_on_the_clause_not_on_the_word():
    scorer = toxicity.ClauseScorer([("snarf", True, 2.0)])
    names = lambda text: {n for n, x in zip(toxicity.FEATURES, scorer.features(text)) if x and n in toxicity.FEATURES[2:20]}
    assert names("Fine day. You are a SNARFER, friend.") == {"insult-aimed-plain"}
    assert names("he said: no; he said it is snarfy") == {"insult-bare-reported"}
    assert names("It is not a snarf") == {"insult-bare-negated"}
    assert names("We will kill all of them") == {"threat-announced-plain", "threat-aimed-plain"}
    assert names("unsnarfed, killers") == set() and names("") == set()


def test_toxicity_finds_held_out_labels(spark):
    """Labels of a larger table: recall and precision on the rows that nothing was learned from."""
    folder = "/root/testdata/sf0.01"
    rows = toxicity.toxicity(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    known = rows.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out and toxic is not null").collect()
    hit = sum(r["predicted"] == 1 and r["toxic"] == 1 for r in known)
    assert hit >= 0.9 * sum(r["toxic"] for r in known) > 5 and hit >= 0.9 * sum(r["predicted"] for r in known)


def test_one_row_of_a_repeated_labelled_id_is_learned_from(spark):
    docs = spark.range(2000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.training_rows(docs, labels, 20_000).count() == 1


def test_labels_that_teach_nothing_drop_nothing(spark):
    docs = docs_of(spark, [f"harmless line number {k} of twelve" for k in range(12)])
    for toxic in ([0, 1], [0, 1, 2, 3, 4, 5, 6], []):
        labels = spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(7)], "doc_id long, quality int, toxic int")
        assert sorted(map(tuple, toxicity.drop_toxic(docs, labels).collect())) == sorted(map(tuple, docs.collect()))
    assert {r["score"] < 1 for r in toxicity.toxicity(docs, labels).collect()} == {True}


def test_stems_of_any_length(spark):
    stem = "unwertgeschoepf"
    texts = [f"du bist ein {stem}{end} und geh weg " + " ".join(words(9, k)) for k, end in enumerate(["e", "es", "er", "en", "em", "ler", "ling", "lein"] * 3)]
    texts += [f"du bist ein unwertgemacht und geh weg " + " ".join(words(9, k)) for k in range(100, 130)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(k, 1, int(k < 24)) for k in range(54)], "doc_id long, quality int, toxic int")
    terms = {t for t, _, _ in toxicity.fit(docs.select("doc_id", "text"), labels, longest_stem=None).lexicon}
    assert any(t.startswith("unwertges") and len(t) > 9 for t in terms)


def test_drop_toxic_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a", 1, 2, 3, "x")], "doc_id long, text string, `row` int, `a.b` int, rest int, score string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert [r.asDict() for r in toxicity.drop_toxic(docs, labels).collect()] == [r.asDict() for r in docs.collect()]


def test_license_rules(spark):
    full = licenses.SENTENCES["mit-grant"].capitalize() + ": " + licenses.SENTENCES["mit-notice"] + "."
    wrapped = "Licensed under the\nApache License, Version 2.0. Fine."
    texts = ["Prose. Released under the MIT License.\nMore.", full, licenses.SENTENCES["mit-notice"] + ". " + licenses.SENTENCES["mit-grant"] + ".", wrapped, None, "", "All rights reserved"]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(docs_of(spark, texts)).collect()}
    assert [got[k] for k in range(7)] == [["MIT"], ["MIT"], [], ["Apache-2.0"], [], [], ["all-rights-reserved"]]
    with pytest.raises(ValueError):
        licenses.check_tables({"a": "no trigger here"}, [])


MIT_NOTICE = """MIT License

Copyright (c) 2024 Some Author

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD_NOTICE = """Copyright (c) 2024, Some Author

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
APACHE_NOTICE = """Copyright 2024 Some Author

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
GPL_NOTICE = """A tool
Copyright (C) 2024  Some Author

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""


BSD_3_NOTICE = BSD_NOTICE + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
LGPL_NOTICE = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
MPL_NOTICE = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
"""
ISC_NOTICE = """Copyright (c) 2024 Some Author

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
CC0_NOTICE = """To the extent possible under law, the author(s) have dedicated all copyright
and related and neighboring rights to this software to the public domain
worldwide. This software is distributed without any warranty.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means.
"""


BSD_3_UNIVERSITY = BSD_NOTICE.replace("1. R", "(1) R").replace("2. R", "(2) R") + """
(3) Neither the name of the University of Somewhere nor the names of its
    contributors may be used to endorse or promote products derived from
    this software without specific prior written permission.
"""
BSD_3_AUTHOR = BSD_NOTICE + """
3. The name of the author may not be used to endorse or promote products
   derived from this software without specific prior written permission.
"""
GPL_2_ONLY = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation.
"""
GPL_2_ONLY_OLD = """ * This program is free software; you can redistribute it and/or
 * modify it under the terms of the GNU General Public License
 * as published by the Free Software Foundation; version 2 of the License.
"""
LGPL_ONLY = """This library is free software; you can redistribute it and/or modify it
under the terms of version 2.1 of the GNU Lesser General Public License as
published by the Free Software Foundation.
"""
APACHE_TEXT = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.

      "Licensor" shall mean the copyright owner or entity authorized by
      the copyright owner that is granting the License.
"""
GPL_2_TEXT = """                            Preamble

  The licenses for most software are designed to take away your
freedom to share and change it.  By contrast, the GNU General Public
License is intended to guarantee your freedom to share and change free
software--to make sure the software is free for all its users.
"""
GPL_3_TEXT = """                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.

  The licenses for most software and other practical works are designed
to take away your freedom to share and change the works.  By contrast,
the GNU General Public License is intended to guarantee your freedom to
share and change all versions of a program--to make sure it remains free
software for all its users.
"""


def test_license_notices_as_published(spark, tmp_path):
    commented = "".join(f" * {line}".rstrip() + "\r\n" for line in APACHE_NOTICE.split("\n"))
    one_line = "A tool\n" + " ".join(GPL_NOTICE.split("\n\n")[1].split()) + "\n" + GPL_NOTICE.split("\n\n")[3].replace("\n", " ")
    whole = [(MIT_NOTICE, "MIT"), (BSD_NOTICE, "BSD-2-Clause"), (APACHE_NOTICE, "Apache-2.0"), (GPL_NOTICE, "GPL-3.0-or-later")]
    whole += [(commented, "Apache-2.0"), (one_line, "GPL-3.0-or-later"), (GPL_NOTICE.replace("software:", "software;"), "GPL-3.0-or-later")]
    whole += [(BSD_3_NOTICE, "BSD-3-Clause"), (LGPL_NOTICE, "LGPL-2.1-or-later"), (MPL_NOTICE, "MPL-2.0"), (ISC_NOTICE, "ISC"), (CC0_NOTICE, "CC0-1.0")]
    whole += [(UNLICENSE, "Unlicense"), (GPL_NOTICE.replace("GNU General", "GNU Affero General"), "AGPL-3.0-or-later")]
    whole += [(GPL_NOTICE.replace("either version 3", "either version 2"), "GPL-2.0-or-later"), ("// SPDX-License-Identifier: Apache-2.0\n", "Apache-2.0")]
    whole += [(BSD_3_UNIVERSITY, "BSD-3-Clause"), (BSD_3_AUTHOR, "BSD-3-Clause"), (GPL_2_ONLY, "GPL-2.0-only"), (GPL_2_ONLY_OLD, "GPL-2.0-only"), (LGPL_ONLY, "LGPL-2.1-only")]
    whole += [(APACHE_TEXT, "Apache-2.0"), (GPL_2_TEXT, "GPL-2.0"), (GPL_3_TEXT, "GPL-3.0"), ("/* SPDX-License-Identifier: GPL-2.0-only */", "GPL-2.0-only")]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(docs_of(spark, [t for t, _ in whole])).collect()}
    assert [got[k] for k in range(len(whole))] == [[name] for _, name in whole]
    odd = [None, "", BSD_NOTICE + "x" + BSD_3_NOTICE, GPL_NOTICE + LGPL_NOTICE + MIT_NOTICE]
    docs_of(spark, [t for t, _ in whole] + odd).write.parquet(f"{tmp_path}/documents.parquet")
    assert_same(QUERIES["op6_licenses"](spark, str(tmp_path)), str(tmp_path), ORACLES["op6_licenses"])
    paragraphs = licenses._paragraphs(F.lit(APACHE_NOTICE))
    address = spark.range(1).select(licenses._identifiers(paragraphs, licenses.SENTENCES).alias("ids"))
    assert address.first()["ids"] == ["apache-ref-2", "apache-use", "apache-copy"]


def brute_links(texts, n, percent):
    """Pairs of indices of texts that link."""

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())

    sets = [shingles(t) for t in texts]
    size = lambda a, b: (len(sets[a] & sets[b]), len(sets[a] | sets[b]))
    pairs = [(a, b, *size(a, b)) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b]]
    return [(a, b) for a, b, both, either in pairs if 100 * both >= percent * either]


def brute_components(texts, n, percent):
    label = list(range(len(texts)))
    for a, b in brute_links(texts, n, percent):
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = [new if x == old else x for x in label]
    words_of = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    runs = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    sizes = [len({tuple(w[k : k + n]) for k in range(len(w) - n + 1)}) if m >= n else int(m > 0) for w, m in zip(runs, words_of)]
    return list(zip(sizes, label))


@pytest.mark.parametrize("block_shingles", [3_000_000, 700, 250])
def test_ngram_join_against_brute_force(spark, block_shingles):
    rng = np.random.default_rng(8)
    texts = [None, "", " ", "one", "ONE", "one two", "É two x", "é two x"]
    for family in range(5):
        base = words(int(rng.integers(30, 200)), family)
        for copy in range(9):
            own = list(base)
            for k in rng.integers(0, len(own), int(rng.integers(0, len(own) // 14 + 2))):
                own[k] = f"n{family}-{copy}-{k}"
            texts.append(" ".join(own))
    texts += [texts[20], texts[20], texts[30]]
    docs, options = docs_of(spark, texts), {"block_shingles": block_shingles, "width_log2": 14}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs, **options).collect()}
    want = brute_components(texts, 3, 90)
    assert [got[k] for k in range(len(texts))] == want
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.ngram_components(docs, count_links=True, **options).collect()}
    links = Counter(x for pair in brute_links(texts, 3, 90) for x in pair)
    assert [got[k] for k in range(len(texts))] == [(*w, links[k]) for k, w in enumerate(want)] and max(links.values()) >= 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 11), min_size=1, max_size=10), min_size=1, max_size=14), st.sampled_from([50, 80, 90]))
def test_prefix_tree_finds_every_link(sets, percent):
    arrays = [np.array(sorted(s), dtype=np.uint32) for s in sets]
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    assert ngram_join.join_classes(arrays, 12, percent) == label


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"))
    got = {r["node"]: r["component"] for r in found.collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)} | {200: 200, 201: 200}


def test_chat_round_trip(spark):
    odd = "\\### Assistant: </turn> <turn:user> \\b\\l\\\\ ok\n"
    rows = [(1, 0, "system", odd), (1, 1, "user", None), (1, 2, "assistant", odd), (1, 3, "user", "x"), (1, 4, "assistant", ""), (1, 5, "user", "end"), (2, 0, "user", "only"), (3, 0, "a<s>\\", "\U0001f600")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examples = chat_format.prefix_examples(df)
    got = {r["conv_id"]: r for r in chat_format.read_examples(examples).collect()}
    for conv in (1, 2, 3):
        own = [(r[2], r[3] or "") for r in rows if r[0] == conv]
        assert [tuple(t) for t in got[conv]["turns"]] == own
        assert got[conv]["loss_texts"] == [t for r, t in own if r == "assistant"]
    assert sorted(r["target"] for r in examples.where("conv_id = 1 and target is not null").collect()) == [2, 4]
    assert chat_format.read_examples(chat_format.prefix_examples(df.where("false"))).count() == 0
    loose = spark.createDataFrame([(None, k, "user", "of no conversation") for k in range(3)], df.schema)
    assert sorted(map(str, chat_format.prefix_examples(df.unionByName(loose)).collect())) == sorted(map(str, examples.collect()))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=60), st.booleans(), st.sampled_from([8, 16]))
def test_planes_round_trip(ids, bits, block):
    ids = np.array(ids, dtype=np.uint32)
    assert token_store.decode_planes(token_store.encode_planes(ids, block, bits)).tolist() == ids.tolist()


@pytest.mark.parametrize("bits", [False, True])
def test_token_store_reads_back_every_document(spark, tmp_path, bits):
    texts = ["Hello, World", None, "", "a b  c\n", "Été!", "last one"] * 20
    token_store.write_store(docs_of(spark, texts).repartition(4), str(tmp_path / "s"), WORD, False, end_id=2, chunk_ids=30, block=8, bits=bits)
    rows = sorted(token_store.read_store(spark, str(tmp_path / "s")).collect(), key=lambda r: r["doc_id"])
    tokenizer, at = Tokenizer.from_file(WORD), 0
    for k, r in enumerate(rows):
        want = [*tokenizer.encode(texts[k] or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (k, at, len(want)) and np.frombuffer(r["ids"], "<u4").tolist() == want
        at += len(want)
    token_store.write_store(docs_of(spark, texts).where("false"), str(tmp_path / "e"), WORD, False)
    assert token_store.read_store(spark, str(tmp_path / "e")).count() == 0


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 8)).round(2)
    x[500:600] = x[0]
    odd = [(9000, None), (9001, [0.0] * 8), (9002, [1.0] * 7), (9003, [float("nan")] * 8), (9004, [None] * 8), (None, [1.0] * 8), (9005, [float("inf")] * 8)]
    df = spark.createDataFrame([(k, x[k].tolist()) for k in range(900)] + odd, "vec_id long, embedding array<float>")
    x = x.astype(np.float32).astype(np.float64)
    index = ann.build_index(df, 8, shard_rows=300)
    rows = ann.search(index, df.where("vec_id % 100 = 0 or vec_id >= 9000"), 8).collect()
    hit = 0
    for q in range(0, 900, 100):
        d = np.sqrt(np.square(x - x[q]).sum(axis=1))
        order = [k for k in np.lexsort((np.arange(900), d)) if k != q][:10]
        own = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)) and all(abs(r["score"] - d[r["vec_id"]]) < 1e-12 for r in own)
        hit += len({r["vec_id"] for r in own} & set(order))
    assert hit >= 0.9 * 90 and {r["query_id"] for r in rows} == set(range(0, 900, 100))
    first = [r["vec_id"] for r in sorted((r for r in rows if r["query_id"] == 0), key=lambda r: r["rank"])]
    assert first == list(range(500, 510))
    assert ann.search(ann.build_index(df.where("vec_id < 3"), 8), df.where("vec_id = 0"), 8).count() == 2
    assert ann.search(ann.build_index(df.where("false"), 8), df.where("vec_id = 0"), 8).count() == 0


def test_recall_over_full_shards_of_usual_width(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(12_288, 64)).astype(np.float32)
    df = spark.createDataFrame(spark.sparkContext.parallelize([(k, x[k].tolist()) for k in range(len(x))], 8), "vec_id long, embedding array<float>")
    index = ann.build_index(df, 64)
    assert index.count() == 3
    rows = ann.search(index, df.where("vec_id % 200 = 0"), 64).collect()
    x, hit, queries = x.astype(np.float64), 0, range(0, len(x), 200)
    for q in queries:
        d = np.square(x - x[q]).sum(axis=1)
        d[q] = np.inf
        hit += len({r["vec_id"] for r in rows if r["query_id"] == q} & set(np.argsort(d)[:10].tolist()))
    assert len(rows) == 10 * len(queries) and hit >= 0.9 * len(rows)
    with pytest.raises(ValueError):
        ann.search(index, df, 64, k=101)


def test_shards_grow_with_the_table():
    assert [ann.shard_count(n, 4096) for n in (0, 4096, 51_000, 1 << 20, 1 << 22, 1 << 30)] == [1, 1, 12, 256, 512, 16384]


def test_longer_stray_vectors_do_not_empty_the_neighbours(spark, tmp_path):
    own = [(k, [float(k), 1.0, 2.0, 3.0]) for k in range(20)]
    stray = [(100, [0.0] * 5), (101, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (102, [1.0] * 7), (103, None)]
    unusable = [(200 + k, [0.0] * 3) for k in range(40)]
    rows = spark.createDataFrame(own + stray + unusable, "vec_id long, embedding array<float>")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert ann.usable_lengths(rows) == [4, 7] and ann.usable_lengths(rows.where("vec_id >= 200")) == []
    found = QUERIES["op10_nearest_neighbours"](spark, str(tmp_path)).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in found] == [(0, k, float(k)) for k in range(1, 11)]


def test_each_length_of_vectors_is_a_space_of_its_own(spark):
    rng = np.random.default_rng(12)
    own = [(k, rng.normal(size=3 + k % 2).tolist()) for k in range(60)]
    rows = spark.createDataFrame(own, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(rows, rows.where("vec_id < 6"), 4, shard_rows=8).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(6):
        near = sorted((math.dist(own[q][1], v), k) for k, v in own if k != q and k % 2 == q % 2)[:4]
        assert sorted(got[q]) == [(n + 1, k, pytest.approx(d)) for n, (d, k) in enumerate(near)]
    assert ann.nearest(rows.where("false"), rows, 4).collect() == []


def test_kept_text_digest(spark, sf_dir):
    row = QUERIES["op1_substring_dedup"](spark, sf_dir).where("n_removed = 0").orderBy("doc_id").first()
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("doc_id") == row["doc_id"]).first()["text"]
    assert row["kept_sha256"] == hashlib.sha256(b" ".join(text.encode().split())).hexdigest()


def thue_morse(n):
    """Two words of n letters that differ everywhere, whose polynomials agree modulo 2 ** 64."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_polynomials_confuse_are_told_apart(spark):
    one, two = thue_morse(4096)
    rest = words(19, 77)
    for first, second in ((one, two), (two, one)):
        texts = [" ".join([first, *rest]), " ".join([second, *rest])]
        got = substring_dedup.substring_dedup(docs_of(spark, texts), 20, width_log2=16).orderBy("doc_id").collect()
        assert [r["n_removed"] for r in got] == [0, 0]
        docs = docs_of(spark, [f"{first} q r", f"{second} q r"])
        assert [r["component_id"] for r in ngram_join.ngram_components(docs, width_log2=14).orderBy("doc_id").collect()] == [0, 1]


def test_rows_of_one_id_are_cut_at_their_own_places(spark):
    base, other = words(40, 31), words(40, 32)
    a, b = " ".join(base), " ".join(other)
    rows = [(1, a), (5, a), (5, b), (5, b), (7, b), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"] or -1, r["n_removed"], r["text"]) for r in substring_dedup.substring_dedup(df, 20, width_log2=16).collect())
    assert got == sorted([(1, 0, a), (5, 40, ""), (5, 0, b), (5, 0, b), (7, 40, ""), (-1, 0, a)])


def test_counters_never_lose_a_repeat_and_stay_apart():
    rng, counts = np.random.default_rng(1), np.zeros(4, dtype=np.uint8)
    for k in range(20_000):
        ngram_join.count_up(counts, np.array([0] + [1] * (k % 10 == 0) + [2] * (k < 2)), rng)
    assert counts[2] == 2 and abs(ngram_join.COUNTER_VALUES[counts[0]] / 20_000 - 1) < 0.5 and counts[0] > counts[1] + 10
    both = ngram_join.add_counters(counts, counts, rng)
    assert both[2] == 4 and both[3] == 0 and counts[0] + 5 < both[0] < counts[0] + 10
    assert all(abs(ngram_join.size_band(s, 90) - ngram_join.size_band(-(-9 * s // 10), 90)) <= 1 for s in range(1, 5000))


@pytest.mark.parametrize("percent", [50, 75, 80, 90, 95, 99, 100])
def test_linked_sets_share_a_signature(percent):
    rng, borders = np.random.default_rng(percent), ngram_join.size_borders(percent)
    for _ in range(300):
        size = int(rng.integers(1, 400))
        x = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
        differ = int(rng.integers(0, (100 - percent) * 2 * size // (100 + percent) + 2))
        less = min(int(rng.integers(0, differ + 1)), len(x))
        y = np.unique(np.concatenate([rng.permutation(x)[less:], rng.integers(0, 1 << 64, differ - less, dtype=np.uint64)]))
        both, either = np.intersect1d(x, y), np.union1d(x, y)
        if len(both) == len(either) or 100 * len(both) < percent * len(either):
            continue
        held = np.where(np.isin(either, both), rng.integers(2, 60, len(either)), rng.integers(1, 60, len(either)))
        one, two = (ngram_join.signatures(s, held[np.searchsorted(either, s)], percent, borders) for s in (x, y))
        assert len(np.intersect1d(one, two))


def test_texts_of_the_same_sentences_are_no_candidates(spark, monkeypatch):
    rng = np.random.default_rng(4)
    sentences = [" ".join(words(8, 500 + k)) for k in range(400)]
    texts = [" ".join(sentences[k] for k in rng.choice(400, 40, replace=False)) for _ in range(60)]
    texts.append(texts[7] + " end")
    classes, made = {}, ngram_join.connected_components

    def spied(edges, name):
        classes[name] = made(edges, name)
        return classes[name]

    monkeypatch.setattr(ngram_join, "connected_components", spied)
    got = ngram_join.ngram_components(docs_of(spark, texts), width_log2=8).orderBy("doc_id").collect()  # a full sketch, as of many texts
    assert [r["component_id"] for r in got] == [*range(60), 7]
    assert classes["shingle-classes"].count() < 10  # most shingles are in some six texts


def test_signatures_of_many_sets_are_those_of_each():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 1 << 64, int(size), dtype=np.uint64)) for size in [0, 1, 2, 5, 900, *rng.integers(0, 400, 60), 0]]
    bounds, flat = np.cumsum([0] + [len(x) for x in sets]), np.concatenate(sets)
    held = rng.integers(0, 60, len(flat)).astype(np.uint8)
    for percent in (60, 80, 90, 100):
        borders = ngram_join.size_borders(percent)
        told, whose = ngram_join.signatures_of_all(flat, bounds, held, percent, borders)
        for k, own in enumerate(sets):
            assert sorted(told[whose == k]) == sorted(ngram_join.signatures(own, held[bounds[k] : bounds[k + 1]], percent, borders))


def test_shingle_sets_of_many_texts_are_those_of_each():
    texts = ["a b c d a b c d a b", "", "a", " \n", "A b", "b a", "x  y\tz", "a b c", "", "c b a", "a b"]
    sets, bounds = ngram_join.Shingler(3).flat(texts)
    split = [t.lower().split() for t in texts]
    want = [{tuple(w[k : k + 3]) for k in range(max(len(w) - 2, 1))} if w else set() for w in split]
    own = [sets[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    assert [len(x) for x in own] == [len(x) for x in want] and all((np.diff(x) > 0).all() for x in own)
    for a, one in zip(own, want):
        for b, two in zip(own, want):
            assert len(np.intersect1d(a, b)) == len(one & two)


@pytest.mark.parametrize("percent", [80, 90])
def test_a_group_around_one_text_costs_each_set_alike(percent):
    def cost(count):
        rng, base, sets = np.random.default_rng(count), np.arange(300, dtype=np.uint32), []
        for _ in range(count):
            gone = rng.choice(300, int(rng.choice([3, 20, 60])), replace=False)  # the first are near copies, others of nothing
            sets.append(np.sort(np.append(np.delete(base, gone), rng.choice(np.arange(300, 900, dtype=np.uint32), len(gone), replace=False))))
        calls = [0]

        def count_call(frame, event, arg):
            calls[0] += event in ("call", "c_call")

        sys.setprofile(count_call)
        try:
            got = ngram_join.join_classes(sets, 900, percent)
        finally:
            sys.setprofile(None)
        held = np.zeros((count, 900))
        for row, own in zip(held, sets):
            row[own] = 1
        linked, label = (100 + percent) * (held @ held.T) >= percent * 600, np.arange(count)
        for _ in range(count):
            label, before = np.array([label[x].min() for x in linked]), label
            if (label == before).all():
                break
        assert got == label.tolist() and max(Counter(got).values()) > count // 4
        return calls[0] / count

    assert cost(400) < 1.5 * cost(100)


def test_counters_stay_at_their_highest():
    counts = np.array([255, 254, 15, 16], dtype=np.uint8)
    ngram_join.count_up(counts, np.arange(4), np.random.default_rng(2), np.array([1, 10**12, 1, 5]))
    assert counts[0] == 255 and counts[1] == 255 and counts[2] == 16 and counts[3] in (18, 19)


def test_signatures_are_packed_and_meet_again():
    rng = np.random.default_rng(6)
    signature, doc = rng.integers(0, 1 << 64, 60_000, dtype=np.uint64), np.repeat(np.arange(600, dtype=np.int64), 100)
    common = rng.integers(0, 1 << 64, 30, dtype=np.uint64)  # that very many documents have
    signature[rng.permutation(60_000)[:3_000]] = common.repeat(100)
    rows, pairs = {}, set()
    for k in range(0, 60_000, 20_000):
        batch = ngram_join.dealt_signatures(signature[k : k + 20_000], doc[k : k + 20_000], 7, k)
        assert sum(len(x or b"") for c in ("signatures", "docs", "pairs") for x in batch.column(c).to_pylist()) < 9 * 20_000
        for row in batch.to_pylist():
            rows.setdefault(row["bucket"], []).append(row)
    for bucket, own in rows.items():
        for made in ngram_join._bucket_pairs((bucket,), iter([pa.RecordBatch.from_pylist(own, schema=batch.schema)])):
            pairs |= set(zip(*(c.to_pylist() for c in made.columns)))
    graph = {k: {k} for k in range(600)}
    for a, b in pairs:
        joined = graph[a] | graph[b]
        for x in joined:
            graph[x] = joined
    for s in common:
        assert len({id(graph[k]) for k in set(doc[signature == s].tolist())}) == 1
    held = {s: set(doc[signature == s].tolist()) for s in common}
    assert all(any({a, b} <= docs for docs in held.values()) for a, b in pairs)
