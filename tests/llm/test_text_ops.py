import hashlib
import random
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from seqspark.llm import decontaminate, licenses, neardups, pagetext, substrings, toxicity
from seqspark.llm import queries as q

PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def frame(spark, rows, clash="n_words int, hashes string"):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in rows], f"doc_id long, text string, {clash}").repartition(3)


def words(rng, n, vocab=400):
    return [f"w{rng.randint(1, vocab)}" for _ in range(n)]


@pytest.fixture(scope="module")
def docs():
    """Fresh texts, exact copies, shared passages, odd ones; ids out of order, one null, one repeated."""
    rng = random.Random(5)
    passage, other = words(rng, 60, 10**6), words(rng, 20, 10**6)
    rows = [(i, " ".join(words(rng, rng.randint(5, 120), 10**6))) for i in range(60)]
    rows += [(100 + i, " ".join(words(rng, 20, 10**6) + passage[i % 7 : 50] + words(rng, 9, 10**6))) for i in range(25)]
    rows += [(200 + i, " ".join(words(rng, 3, 10**6) + other + other)) for i in range(4)]
    rows += [(300, None), (301, ""), (302, " \n "), (303, "one two"), (None, " ".join(passage)), (305, " ".join(words(rng, 3000, 50)))]
    rows += [(7, rows[8][1]), (7, rows[8][1]), (310, "Case\x0bTab\tÜ x " * 9)]
    rng.shuffle(rows)
    return rows


def brute_repeats(rows):
    low, out = {}, []
    parts = [(i if i is not None else 2**62, i, PLAIN.findall(t or "")) for i, t in rows]
    for k, _, ws in parts:
        for p in range(len(ws) - 12):
            g = tuple(ws[p : p + 13])
            low[g] = min(low.get(g, k), k)
    for k, i, ws in parts:
        gone = {j for p in range(len(ws) - 12) if low[tuple(ws[p : p + 13])] < k for j in range(p, p + 13)}
        kept = [w for j, w in enumerate(ws) if j not in gone]
        out.append((i, len(ws), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def none_first(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("chunk", [400, 3000, 10**6])
def test_substrings_against_brute_force(spark, docs, chunk):
    df = frame(spark, docs)
    assert none_first(substrings.repeated_words(df, chunk).collect()) == none_first(brute_repeats(docs))


def test_substrings_keep_columns(spark, docs):
    df = frame(spark, docs)
    out = substrings.remove_repeats(df, 2000)
    assert out.schema == df.schema and out.count() == len(docs)
    kept = {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out.collect()}
    assert kept == {(r[0], r[3]) for r in brute_repeats(docs)}
    assert substrings.repeated_words(df.where("false")).collect() == []


def brute_overlap(rows, items, window=10):
    wins = {}
    for i, t in items:
        ws = ALNUM.findall(lower(t))
        k = min(window, len(ws))
        for p in range(len(ws) - k + 1 if k else 0):
            wins.setdefault((k, tuple(ws[p : p + k])), set()).add(str(i))
    out = []
    for i, t in rows:
        ws, hit, ids = ALNUM.findall(lower(t)), set(), set()
        for k in {k for k, _ in wins}:
            for p in range(len(ws) - k + 1):
                if (own := wins.get((k, tuple(ws[p : p + k])))) is not None:
                    ids |= own
                    hit |= set(range(p, p + k))
        out.append((i, len(ws), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


ITEMS_RNG = random.Random(8)
ITEMS = [(i, " ".join(words(ITEMS_RNG, n, 60))) for i, n in enumerate([30, 10, 4, 1, 55, 12])] + [(9, None), (10, "?!"), (2, "W5 w6"), (12, "a a a a a a a a a a a a")]


@pytest.mark.parametrize("block", [10**6, 150])
def test_overlap_against_brute_force(spark, block):
    rng = random.Random(3)
    rows = [(i, " ".join(words(rng, rng.randint(0, 80), 60))) for i in range(40)]
    for i, (_, t) in enumerate(ITEMS * 3):
        ws = (t or "").split()
        rows.append((50 + i, " ".join(words(rng, 9, 60) + ws[i % 5 :] + words(rng, 5, 60) + ws[:11])))
    rows += [(99, None), (None, ITEMS[0][1].upper()), (98, "a " * 40), (98, "a " * 40)]
    got = decontaminate.overlap(frame(spark, rows), spark.createDataFrame(ITEMS, "item_id long, text string"), block_chars=block)
    assert none_first(got.collect()) == none_first(brute_overlap(rows, ITEMS))


def test_longest_matches_and_removal(spark):
    item = " ".join(f"k{i}" for i in range(30))
    inside = "x y " + " ".join(f"k{i}" for i in range(5, 25)) + " z"
    df = frame(spark, [(1, inside), (2, "k1 k2 k3"), (3, None), (4, item + " " + item)])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = sorted(map(tuple, decontaminate.longest_matches(df, bench).collect()))
    assert got == [(1, 2, "1", 5, 20), (4, 0, "1", 0, 30), (4, 30, "1", 0, 30)]
    left = decontaminate.remove_contaminated(df, bench)
    assert left.schema == df.schema and sorted(r.doc_id for r in left.collect()) == [2, 3]
    assert decontaminate.overlap(df.where("false"), bench).collect() == []
    assert not any(r.contaminated for r in decontaminate.overlap(df, bench.where("false")).collect())


def test_repetitive_text_costs_no_more(spark):
    rows = [(1, "a " * 200_000), (2, "a b " * 50_000), (3, "x " * 9 + "a " * 10), (4, None)]
    items = [(1, "a " * 100_000), (2, "b a " * 3000), (3, "a " * 12)]
    got = decontaminate.overlap(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got.collect()) == [(1, 200_000, 200_000, 2), (2, 100_000, 100_000, 1), (3, 19, 10, 2), (4, 0, 0, 0)]
    one = decontaminate.Items.of([("1", "a " * 3000)], 10)
    found = [m for part in decontaminate.Shard.of(["b " + "a " * 5000], one).matches(one, 500) for m in zip(*map(np.ndarray.tolist, part))]
    # from the item's first word, or from the first a of the text
    assert sorted(found) == sorted([(0, 1 + i, 0, 0, min(3000, 5000 - i)) for i in range(4991)] + [(0, 1, 0, i, 3000 - i) for i in range(1, 2991)])


@pytest.mark.parametrize("block", [10**6, 150])
def test_matches_and_removal_against_brute_force(spark, block):
    rng = random.Random(12)
    items = [(i, " ".join(words(rng, rng.randint(8, 30), 2))) for i in range(6)]
    rows = [(i, " ".join(words(rng, rng.randint(5, 60), 2))) for i in range(90)]
    want = set()
    for d, t in rows:
        a = t.split()
        for i, u in items:
            b = u.split()
            least = min(10, len(b))
            for x in range(len(a)):
                for y in range(len(b)):
                    n = 0
                    while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                        n += 1
                    if n >= least and (x == 0 or y == 0 or a[x - 1] != b[y - 1]) and y + least <= len(b):
                        want.add((d, x, str(i), y, n))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontaminate.longest_matches(frame(spark, rows), bench, block_chars=block).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    left = decontaminate.remove_contaminated(frame(spark, rows), bench, block_chars=block)
    assert sorted(r.doc_id for r in left.collect()) == sorted({d for d, _ in rows} - {m[0] for m in want})


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    for _ in range(20):
        w = rng.integers(1, 4, rng.integers(1, 200)).astype(np.uint64)
        order = decontaminate.suffix_array(w, 16)
        keys = [tuple(w[i : i + 16].tolist()) for i in order]
        assert keys == sorted(keys) and sorted(order.tolist()) == list(range(len(w)))


def test_licenses(spark):
    rows = [
        (1, "Licensed under the Apache License, Version 2.0."), (2, "licensed under apache license"), (3, "Licensed under a Apache License"),
        (4, "x Licensed under CC BY-NC 4.0. cc by"), (5, "GENERAL PUBLIC LICENSE"), (6, "Copyright (c) 2020 Some Name. All rights reserved"),
        (7, None), (8, ""), (9, "Released under the MIT License."), (9, "Released under the MIT License."), (10, "licensed under the gnu lesser general public license version 3"),
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, rows, "labels int, score string")).collect()}
    labels = {k: r.labels for k, r in got.items()}
    assert labels == {1: "notice-apache", 2: "notice-apache", 3: "", 4: "cc-by,notice-cc", 5: "gpl", 6: "notice-reserved,reserved", 7: "", 8: "", 9: "notice-mit", 10: "gpl,notice-gpl"}
    assert (got[4].n_base, got[4].first_word, got[4].last_word) == (2, 3, 8) and got[7].first_word is None and got[5].score == 0.5
    texts = {
        "text-mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software.',
        "text-bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \u201cAS IS\u201d AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT OWNER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "text-apache-2-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "text-gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.",
        "text-mpl-2-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    }
    less = lambda t: " ".join(w for i, w in enumerate(t.split()) if i != 12)  # noqa: E731  a mandatory word is missing
    wordings = [(k, f"// x {t} y") for k, t in enumerate(texts.values())] + [(10 + k, less(t)) for k, t in enumerate(texts.values())]
    found = {r.doc_id: [x for x in r.labels.split(",") if x.startswith("text-")] for r in licenses.scan_licenses(frame(spark, wordings)).collect()}
    assert [found[k] for k in range(5)] == [[label] for label in texts] and not any(found[10 + k] for k in range(5))
    for label, markup in licenses.TEMPLATES.items():  # the automaton and the pattern accept alike
        t, pattern = licenses.Template.compile(label, markup), re.compile(licenses.Template.regex(markup))
        rng = random.Random(1)
        pool = sorted(set(ALNUM.findall(re.sub("<<.*?>>", " ", markup)))) + ["2", "0", "sa", "nd", "released", "foo"]
        for _ in range(3000):
            ws = [rng.choice(pool) for _ in range(rng.randint(1, 12))]
            assert any(t.match(iter(ws[i:])) for i in range(len(ws))) == bool(pattern.search(" " + " ".join(ws) + " "))


def brute_near(rows):
    sets = []
    for _, t in rows:
        ws = PLAIN.findall(lower(t))
        sets.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
    ids = [i for i, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            u = len(sets[a] | sets[b])
            if None not in (ids[a], ids[b]) and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * u or ids[a] == ids[b] is not None:
                root[find(a)] = find(b)
    comp = {}
    for i in range(len(rows)):
        if ids[i] is not None:
            comp[find(i)] = min(comp.get(find(i), ids[i]), ids[i])
    return {(ids[i], len(sets[i]), comp.get(find(i)), ids[i] == comp.get(find(i))) for i in range(len(rows))}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(1000 + i, " ".join(words(rng, rng.randint(1, 60), 10**6))) for i in range(40)]
    base = words(rng, 150, 10**6)
    for i in range(90):  # one large group whose members are linked to some of the others only
        ws = base[:]
        for _ in range(rng.randint(1, 9)):
            ws[rng.randrange(150)] = f"v{rng.randint(1, 10**6)}"
        rows.append((2000 + i, " ".join(ws)))
    line = " ".join(words(rng, 40, 10**6))
    rows += [(3000 + i, line + " " + " ".join(words(rng, 110, 10**6))) for i in range(40)]
    rows += [(4000 + i, " ".join(base)) for i in range(30)] + [(5000 + i, "two Words" if i % 2 else "two words") for i in range(4)]
    rows += [(6000, None), (6001, ""), (6002, "\t"), (6003, "two words"), (6003, "two words"), (None, " ".join(base)), (None, "alone but not lost")]
    rng.shuffle(rows)
    df = frame(spark, rows, "component_id int, n_shingles string")
    got = neardups.near_components(df)
    assert {tuple(r) for r in got.collect()} == brute_near(rows) and got.count() == len(rows)
    kept = neardups.one_of_each(df)
    assert kept.schema.names == df.schema.names
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in brute_near(rows) if r[3]}
    assert neardups.near_components(df.where("false")).collect() == []


def test_near_duplicates_of_one_id_with_several_texts(spark):
    rng = random.Random(9)
    t1, t2, t3 = (" ".join(words(rng, 40, 10**6)) for _ in "123")
    rows = [(5, t1), (5, t2), (9, t2 + " extra"), (3, t3), (7, t3), (7, None), (7, t1), (11, ""), (11, t3 + " more"), (12, t1 + " x"), (13, "alone here")]
    got = neardups.near_components(frame(spark, rows))
    assert {tuple(r) for r in got.collect()} == brute_near(rows) and got.count() == len(rows)


@pytest.mark.parametrize("wide", [5, 10**6])
def test_near_duplicates_that_share_boilerplate(spark, monkeypatch, wide):
    monkeypatch.setattr(neardups, "WIDE", wide)
    rng = random.Random(14)
    rows = []
    for share in (30, 70, 105):  # of some 130 words
        line = words(rng, share, 10**6)
        for i in range(60):
            own = words(rng, 130 - share, 10**6)
            rows.append((1000 * share + 2 * i, " ".join(line + own)))
            if i % 6 == 0:  # a near copy in another order of ids
                own[3] = "changed"
                rows.append((1000 * share + 999 - i, " ".join(line + own)))
    rng.shuffle(rows)
    want = brute_near(rows)
    assert {tuple(r) for r in neardups.near_components(frame(spark, rows)).collect()} == want
    assert 20 < sum(not r[3] for r in want) < 60


def test_very_long_texts(spark):
    from seqspark.llm import tokencounts

    long = "la " * 700_000 + "cc by " + "x " * 5
    df = frame(spark, [(1, long), (2, long + "y"), (3, "short text here"), (4, None)])
    items = spark.createDataFrame([(1, "la " * 12)], "item_id long, text string")
    assert sorted((r.doc_id, r.n_words, r.n_hit) for r in decontaminate.overlap(df, items).collect()) == [(1, 700_007, 700_000), (2, 700_008, 700_000), (3, 3, 0), (4, 0, 0)]
    scanned = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert (scanned[1].n_words, scanned[1].n_base, scanned[1].first_word, scanned[1].labels) == (700_007, 1, 700_000, "cc-by")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardups.near_components(df).collect()) == [(1, 8, 1), (2, 9, 1), (3, 1, 3), (4, 0, 4)]
    assert sorted((r.doc_id, r.n_words) for r in tokencounts.token_counts(df, q.vocabulary_path()).collect()) == [(1, 700_007), (2, 700_008), (3, 3), (4, 0)]
    assert sorted((r.doc_id, r.n_removed) for r in substrings.repeated_words(df).collect()) == [(1, 0), (2, 700_007), (3, 0), (4, 0)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1040)]
    got = {r.node: r.component for r in neardups.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for n, c in got.items():
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        assert c == min(seen)
    assert set(got) == {n for n, ms in near.items() if ms != {n}}


def test_toxicity(spark, sf):
    got = {r.doc_id: r for r in q.op3_toxicity(spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for d, r in got.items())
    held = [(got[d].predicted, y) for d, y in labels.items() if d in got and got[d].held_out]
    assert np.mean([p == y for p, y in held]) >= 0.9
    assert np.mean([p for p, y in held if y]) >= 0.75 and np.mean([1 - p for p, y in held if not y]) >= 0.97
    scores = [(got[d].score, y) for d, y in labels.items() if d in got and got[d].held_out]
    assert np.mean([(a > b) + (a == b) / 2 for a, y in scores if y for b, x in scores if not x]) >= 0.93  # area under the curve
    odd = frame(spark, [(1, None), (2, ""), (2, ""), (None, "idiot")], "toxic int, score string")
    model = toxicity.fit(["idiot moron the of", "fine words the of"] * 60, np.array([1, 0] * 60), steps=30)
    out = toxicity.score(odd, model).collect()
    assert len(out) == 4 and len({r.score for r in out if r.doc_id in (1, 2)}) == 1
    assert [r.predicted for r in out if r.doc_id is None] == [1]
    assert toxicity.fit(["a", "b"], np.array([1, 1])) is None and toxicity.score(odd, None).where("score = 0").count() == 4
    assert toxicity.score(odd.where("false"), model).collect() == []


def test_op3_long_texts_and_labels_without_documents(spark, monkeypatch):
    model = toxicity.fit(["idiot moron the of", "fine words the of"] * 60, np.array([1, 0] * 60), steps=30)
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["fine", "words", "the", "of", "und", "idiot", "moron"], k=n)) for n in (1, 2, 3, 7, 60, 400)] + ["x" * 90, " " * 90, None]
    whole = toxicity._logits(model, texts)
    monkeypatch.setattr(toxicity, "PIECE_CHARS", 20)
    pieces = toxicity._logits(model, texts)
    assert np.allclose(whole[0], pieces[0], atol=1e-5) and (whole[1] == pieces[1]).all()
    docs = spark.createDataFrame([(i, f"idiot moron {i}" if i % 2 else f"fine words {i}", None) for i in range(200)] * 2, "doc_id long, text string, toxic string")
    labels = spark.range(100_000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic", "'x' AS text")
    found = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(found) == 400 and all(r.predicted == r.doc_id % 2 for r in found)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><div id=top><a href=/>Home</a></div>
<div class="col"><ul class=links><li>One<li>Two</ul></div><div class="story"><h1>{h}</h1><p>{a} &amp; more&nbsp;text<br>line<p><b>{b}<p>Same words everywhere
<div class="comments"><p>nice post</div></div><div>Site of the year</div><form>Search <input></form></body>"""


def test_pages_without_marks_use_the_template(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(h=f"Head {i}", a=f"alpha {i}", b=f"beta {i}")) for i in range(5)]
    rows += [(7, None, None), (8, "x", ""), (9, "http://solo.example", "<p>a<p>b <script>x"), (9, "http://solo.example", "<p>a<p>b <script>x"), (10, "http://u.example/", "<" * 50 + "é" * 10)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id int, url string, html string, text string").repartition(2)
    got = {r.page_id: r for r in pagetext.extract_text(df).collect()}
    assert got[3].text == "Head 3\nalpha 3 & more text line\nbeta 3"
    assert got[7].text == got[8].text == "" and got[9].text == "a\nb" and all(r.n_chars == len(r.text) for r in got.values())
    assert pagetext.extract_text(df).count() == len(rows) and pagetext.extract_text(df.where("false")).collect() == []


def test_pages_with_articles():
    page = "<nav>menu</nav><header>top</header><article><header><h1>Title</h1></header><p>One <a href=x>li<b>n</b>k</a>, &lt;two&gt;&#33;</p><aside>side</aside><div class='ad-box'>buy</div><ul><li>x<li>y</ul><table><tr><td>c1<td>c2</table><section id=comments><article class=comment>troll</article></section></article><footer>end</footer>"
    assert pagetext.main_text(page) == "Title\nOne link, <two>!\nx\ny\nc1\nc2"
    copy = pagetext.parse(page)
    assert pagetext.main_text(page, [copy]) == pagetext.main_text(page)


def test_alignment_is_largest():
    a, b = pagetext.parse("<div><p>1</p><ul><li>x</li></ul><p>2</p></div>"), pagetext.parse("<div><ul><li>x</li><li>y</li></ul><p>2</p><p>3</p></div>")
    assert pagetext.align(a, b, []) == 5  # root, div, ul, li, p


class Plain(HTMLParser):
    """Another reading of well-formed pages: blocks of <article>, without scripts and asides."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skipped, self.blocks = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.skipped += tag in ("script", "style", "nav", "footer", "aside", "form")
        if tag == "br":
            self.blocks[-1] += " "
        elif tag not in pagetext.INLINE and tag != "img":
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.skipped -= tag in ("script", "style", "nav", "footer", "aside", "form")
        if tag not in pagetext.INLINE:
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside and not self.skipped:
            self.blocks[-1] += data


def test_op8_whole(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r.text for r in q.op8_page_text(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        plain = Plain()
        plain.feed(r.html)
        plain.close()
        assert got[r.page_id] == "\n".join(t for b in plain.blocks if (t := " ".join(b.split()))), r.page_id


def test_pages_of_any_shape():
    deep = "<body>" + "<div>" * 50_000 + "x" + "</div>" * 50_000
    assert pagetext.main_text(deep, [pagetext.parse(deep)]) == "x"
    items = [f"<li>{i}</li>" for i in range(20_000)]
    page = lambda own: "<body><h1>Menu</h1><ul>" + "".join(items[:9000] + own + items[9000:]) + "</ul><p>End</p></body>"
    own = [f"<li>own {i}</li>" for i in range(600)]
    got = pagetext.main_text(page(own[:300]), [pagetext.parse(page(own[k : k + 300])) for k in (300, 200, 250)])
    assert got == "\n".join(f"own {i}" for i in range(250))  # all else stands on three of the four pages at least
    for odd in ("<a " * 50_000, '<a "' * 50_000, "<b>" * 50_000 + "y", "<div>" * 20_000 + "</p></span>" * 20_000, "<li>" * 20_000):
        assert len(pagetext.main_text(odd)) <= len(odd)


def test_names_that_articles_use_too_leave_nothing_out():
    page = "<body><article><h2>T</h2><div class='related work'>cited</div><section id=search>how we searched</section><p class=notice>mind this</p><div class='ad slot'>buy</div></article><div class=search>find</div></body>"
    assert pagetext.main_text(page) == "T\ncited\nhow we searched\nmind this"


def test_long_lists_align_like_short_ones(monkeypatch):
    rng = random.Random(6)
    for _ in range(60):
        a, b = ("<ul>" + "".join(f"<li class={rng.choice('ab')}>{rng.choice('xyz')}</li>" for _ in range(rng.randint(1, 12))) + "</ul>" for _ in "12")
        sizes = []
        for small in (400, 0):
            monkeypatch.setattr(pagetext, "SMALL", small)
            x, y = pagetext.parse(a), pagetext.parse(b)
            pagetext.keyed(x), pagetext.keyed(y)
            pairs = []
            sizes.append(pagetext.align(x, y, pairs))
            at = [[id(c) for c in t.children[0].children] for t in (x, y)]
            lists = sorted((at[0].index(id(p)), at[1].index(id(q))) for p, q in pairs if p.tag == "li")
            assert all(i < k and j < m for (i, j), (k, m) in zip(lists, lists[1:]))
        assert sizes[0] == sizes[1]


def test_large_subtrees_that_differ_align_by_their_weight(monkeypatch):
    """Of two blocks the one with more in common is a pair, however large they are, and ties do not depend on what is kept."""
    for n in (3, 30):
        box = lambda own: "<div>" + "".join(f"<p>{w}</p>" for w in own) + "</div>"  # noqa: E731, B023
        same, other = [f"s{i}" for i in range(n)], [f"o{i}" for i in range(n)]
        a, b = pagetext.parse(box([*same, "x"])), pagetext.parse(box(other) + box([*same, "y"]))
        pagetext.keyed(a), pagetext.keyed(b)
        assert pagetext.align(a, b, []) == n + 2
    rng = random.Random(5)

    def tree(depth):
        return "".join(f"<{(t := rng.choice(('div', 'ul')))}>{tree(depth - 1) if depth else ''}</{t}>" if rng.random() < 0.6 else f"<p>{rng.choice('xyz')}</p>" for _ in range(rng.randint(1, 4)))

    def plain(x, y):
        best = [[0] * (len(y.slots) + 1) for _ in range(len(x.slots) + 1)]
        for i, c in enumerate(x.slots):
            for j, d in enumerate(y.slots):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (plain(c, d) if pagetext._fits(c, d) else 0))
        return 1 + best[-1][-1]

    for _ in range(80):
        x, y = pagetext.parse(tree(3)), pagetext.parse(tree(3))
        pagetext.keyed(x), pagetext.keyed(y)
        found = []
        for small, held in ((400, 1_000_000), (0, 1_000_000), (0, 1)):
            monkeypatch.setattr(pagetext, "SMALL", small)
            monkeypatch.setattr(pagetext, "HELD", held)
            pairs = []
            assert pagetext.align(x, y, pairs) == plain(x, y)
            found.append({(id(p), id(q)) for p, q in pairs})
        assert found[0] == found[1] == found[2]


def test_op8_counts_over_all_pages_of_a_host_inside_articles(spark):
    page = "<body><nav>m</nav><article><h1>Head {i}</h1><p>alpha {i}</p>{box}<p>beta {i}</p></article></body>"
    box = "<div class=teal><p>Read more on our site</p></div>"
    rows = [(i, f"http://a.example/{i}", page.format(i=i, box=box if 0 < i < 8 else "")) for i in range(9)]  # not on the first and last page
    # copies and two pages with the same passage are no template
    rows += [(20 + i, f"http://b.example/{i}", page.format(i=0 if i < 6 else i, box="")) for i in range(8)]
    rows += [(40 + i, f"http://c.example/{i}", f"<body><div><p>shared passage</p></div><p>own {i}</p></body>" if i < 2 else f"<body><p>own {i}</p></body>") for i in (0, 2, 3, 4, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in pagetext.extract_text(df).collect()}
    assert all(got[i] == f"Head {i}\nalpha {i}\nbeta {i}" for i in range(9))
    assert all(got[20 + i] == "Head 0\nalpha 0\nbeta 0" for i in range(6)) and got[26] == "Head 6\nalpha 6\nbeta 6"
    assert got[40] == "shared passage\nown 0" and got[41] == "shared passage\nown 1" and got[42] == "own 2"


def test_op3_thresholds_cover_long_texts_and_the_sample_is_filled(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_TOXIC", 150)
    monkeypatch.setattr(toxicity, "MAX_CLEAN", 150)
    rng, rows = random.Random(3), []
    fill = [f"wort{i}" for i in range(300)]
    for i in range(1200):
        y, long = i % 2, i % 3 == 0
        if long:  # German; the clean ones hold one of the words
            ws = "der die das und ist nicht ein mit".split() + rng.choices(fill, k=900) + (["idiot", "moron", "scum"] * 2 if y else ["idiot"])
        else:
            ws = "the of and to in is it that".split() + rng.choices(fill, k=30) + (rng.sample(["idiot", "moron", "scum"], 2) if y else [])
        rng.shuffle(ws)
        rows.append((i, " ".join(ws), y))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    sizes, fit = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: sizes.append(len(texts)) or fit(texts, labels))
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert sizes == [300]
    got = toxicity.score(df.where("length(text) > 6000"), model).join(df, "doc_id").collect()
    assert len(got) > 300 and {r.language for r in got} == {"de"}
    assert sum(r.predicted == r.toxic for r in got) > 0.97 * len(got)
