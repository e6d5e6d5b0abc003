"""The corpus operators against brute force, libraries and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from strandflow.llm import decontam, licenses, near_dup, packing, quality_ranker, quality_rules, queries, token_counts, toxicity, url_filter, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, row string, t string, words string, id long, label int"


def docs_of(spark, texts):
    """Documents with other columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "r", "t", "w", i, 7) for i, t in texts], DOCS)


def vocabulary(rng, n=60):
    return ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def edge_texts():
    long = " ".join(f"w{i % 700}" for i in range(25_000))
    return [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one"), (5, "Two words"), (6, long), (7, long), (8, "a b c d e a b c d e\nx\nx\n\n"), (9, "  double  spaces   and\n\nlines  "), (10, "<|endoftext|> <s> ▁x 你好 \x00 end"), (None, "no id here at all")]


@pytest.fixture(scope="module")
def edge(spark, edge_texts):
    return docs_of(spark, edge_texts)


def brute_rules(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    hit = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_rules_against_brute_force(spark, edge, edge_texts):
    rng = random.Random(4)
    texts = edge_texts + [(100 + i, " ".join(rng.choice(["a", "b", "c#"]) + rng.choice(["", "\n"]) for _ in range(rng.randint(0, 60)))) for i in range(40)]
    got = quality_rules.ledger(docs_of(spark, texts)).select("row.c0", F.col("row.c1").alias("text"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[2:] == brute_rules(r.text), r.text
    assert quality_rules.keep_good(docs_of(spark, texts)).columns == edge.columns


def test_rule_policies_and_ablation(spark):
    book = quality_rules.ledger(docs_of(spark, [(1, "short"), (2, "a1 b2 c3 d4 e5 f6 g7 h8 i9 j10 k11"), (3, "# # # #")]))
    kept = {r.doc_id for r in book.filter(quality_rules.passes()).select(F.col("row.c0").alias("doc_id")).collect()}
    assert kept == {2}
    per = {r.rule: (r.failed, r.only_this) for r in quality_rules.ablation(book).collect()}
    assert per["too_few_words"] == (2, 1) and per["symbols"] == (1, 0)


def jaccard_components(texts, k, percent):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().translate(near_dup._LOWER).split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_against_brute_force(spark, k):
    rng = random.Random(k)
    vocab, texts = vocabulary(rng, 400), [(0, None), (1, ""), (2, "one two"), (3, "ONE two"), (4, "  ")]
    passage = [rng.choice(vocab) for _ in range(40)]
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 120))] + (passage if g % 2 else [])
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append((len(texts), " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs_of(spark, texts), k, 80).collect()}
    assert got == jaccard_components(texts, k, 80)


def test_last_round_finds_what_stars_miss(spark):
    """A chain of variants: neighbours are linked, ends are not."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(30):
        texts.append((i, " ".join(words)))
        for _ in range(4):
            words[rng.randrange(300)] = f"v{rng.randrange(10**6)}"
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs_of(spark, texts), 5, 80).collect()}
    assert got == jaccard_components(texts, 5, 80)


def test_near_duplicates_edges(spark, edge):
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(edge).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6, 7: 6, 8: 8, 9: 9, 10: 10, None: None}
    kept = near_dup.keep_one(edge)
    assert kept.columns == edge.columns and kept.count() == 10
    assert near_dup.near_duplicates(edge.limit(0)).count() == 0


def test_sequential_test_keeps_links():
    n, m = near_dup.least_matches(0.8)[-1]
    assert n == near_dup.N_HASH and 0.5 * n < m < 0.75 * n


def brute_hits(text, items):
    low = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, names = low(text), set(), set()
    for i, t in items:
        x = low(t)
        m = min(13, len(x))
        wins = {tuple(x[j : j + m]) for j in range(len(x) - m + 1)} if x else set()
        for j in range(len(w) - m + 1):
            if wins and tuple(w[j : j + m]) in wins:
                hit |= set(range(j, j + m))
                names.add(str(i))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


@pytest.mark.parametrize("block", [10**6, 300])
def test_decontamination_against_brute_force(spark, edge_texts, block):
    rng = random.Random(8)
    vocab = vocabulary(rng, 12)
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([1, 2, 5, 13, 14, 30, 40, 12])] + [(8, ""), (9, None), (10, "...")]
    texts = [t for t in edge_texts if t[0] is not None]
    for i in range(60):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
        if i % 2:
            words += items[i % 8][1].upper().split() + [rng.choice(vocab) for _ in range(9)]
        texts.append((100 + i, ", ".join(words)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.scan_documents(docs_of(spark, texts), bench, block_bytes=block).collect()
    assert len(got) == len(texts)
    want = {i: brute_hits(t, items) for i, t in texts}
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == want[r.doc_id]
        assert r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words)
    assert decontam.scan_documents(docs_of(spark, texts[:3]), bench.limit(0)).filter("n_hit > 0").count() == 0


def test_removed_spans():
    assert decontam.remove_spans("Keep this: BAD, words; then é this", [2, 4]) == "Keep this: ; then é this"
    assert decontam.remove_spans(None, [0, 1]) is None


@pytest.mark.parametrize("limits", [{}, {"block_bytes": 100}])
def test_decontamination_by_row(spark, limits):
    bench = spark.createDataFrame([(i, " ".join(f"q{i}x{j}" for j in range(20))) for i in range(3)], "item_id long, text string")
    bad, clean = " ".join(f"q1x{j}" for j in range(20)), " ".join(f"w{i}" for i in range(30))
    docs = docs_of(spark, [(None, bad), (None, clean), (7, bad), (7, clean + " more"), (8, None)])
    got = decontam.drop_contaminated(docs, bench, **limits)
    assert got.columns == docs.columns
    assert sorted(map(repr, got.collect())) == sorted(repr(r) for r in docs.collect() if r.text != bad)


def test_spans_are_cut_from_long_documents(spark):
    bench = spark.createDataFrame([(1, " ".join(f"q{j}" for j in range(50)))], "item_id long, text string")
    head, tail, passage = " ".join(f"é{i}" for i in range(900)), " ".join(f"w{i}" for i in range(1000)), " ".join(f"q{j}" for j in range(20, 40))
    docs = docs_of(spark, [(1, f"{head}. {passage} {tail}"), (2, head)])
    got = {r.doc_id: r.text for r in decontam.drop_contaminated(docs, bench).collect()}
    assert got == {1: f"{head}.  {tail}", 2: head}


def test_quality_by_row(spark):
    good, bad = "plain sentences about rivers and towns with many different words in them", "!!! ### !!! ### !!! ### !!! ### !!! ###"
    texts = [(i, f"{good} {i}" if i % 2 else f"{bad} {i}") for i in range(40)] + [(None, good), (None, bad), (99, good), (99, bad)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = quality_ranker.keep_good(docs, labels)
    assert got.columns == docs.columns
    assert sorted(map(repr, got.collect())) == sorted(repr(r) for r in docs.collect() if r.text.startswith(good))


def test_token_counts_are_the_librarys(spark, edge_texts):
    import public_tokenizers as files
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=files.path("piece_bpe_32k.model"))
    rng = random.Random(2)
    texts = [t for t in edge_texts if t[0] is not None]
    texts += [(100 + i, "".join(rng.choice(["word", " ", "  ", "\n", "é", "▁", "<s>", "don't", "12", ".", "你", "\t", "🙂"]) for _ in range(rng.randint(0, 40)))) for i in range(200)]
    got = {r.doc_id: r for r in token_counts.token_counts(docs_of(spark, texts)).collect()}
    for i, t in texts:
        assert got[i].n_tokens == len(sp.encode(t or "")), t
        assert got[i].n_bytes == len((t or "").encode()) and got[i].over_limit == (got[i].n_tokens > 4096)


def test_packing_round_trip(spark, edge_texts):
    import public_tokenizers as files
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    texts = [t for t in edge_texts if t[0] is not None]
    texts += [(100 + i, "".join(rng.choice(["word", " ", "  ", "\n", "é", "'s", "’", "<|endoftext|>", "12", "...", "你", " ", "🙂"]) for _ in range(rng.randint(0, 400)))) for i in range(150)]
    pieces = packing.pack(docs_of(spark, texts), size=256).toPandas()
    for i, t in texts:
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        own = pieces[pieces.doc_id == i].sort_values("start")
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        for p in own.itertuples():
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    pieces = pieces.sort_values(["sequence_id", "offset"])
    ends = pieces.offset + pieces.length
    assert (ends.groupby(pieces.sequence_id).shift(fill_value=0) == pieces.offset).all()
    sizes = pieces.groupby("sequence_id").length.sum()
    assert (sizes.iloc[:-1] == 256).all() and sizes.iloc[-1] <= 256
    assert packing.pack(docs_of(spark, texts).limit(0)).count() == 0


def test_hilbert_curve_is_continuous():
    n, bits = 3, 3
    side = 1 << bits
    points = np.stack(np.meshgrid(*[np.arange(side)] * n, indexing="ij"), axis=-1).reshape(-1, n)
    keys = packing.hilbert(points, bits)
    assert sorted(keys) == list(range(side**n))
    walk = points[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "same"), (2, None, "same"), (3, "x\r\ny", None), (4, "u", ""), (5, "u", "own"), (5, "u", "own"), (None, "u", "null id")]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string")
    got = {(r.page_id, r.payload_bytes): (r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    import base64

    b32 = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    assert got[(1, 4)] == (b32("same"), "revisit", 2) and got[(2, 4)] == (b32("same"), "response", None)
    assert got[(3, 0)] == (b32(""), "revisit", 4) and got[(5, 3)] == (b32("own"), "response", None) and got[(None, 7)] == (b32("null id"), "response", None)
    least = {r.page_id: r.record_type for r in warc.round_trip(pages, least=5).collect()}
    assert least[1] == "response"
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_records_are_whole(spark, tmp_path):
    pages = spark.createDataFrame([(7, "http://h/p", "<b>é</b>")], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "w"))
    record = bytes(warc.read_archive(spark, str(tmp_path / "w")).first().record)
    assert warc.read_archive(spark, str(tmp_path / "w")).first().payload == "<b>é</b>".encode()
    head, body = record.split(b"\r\n\r\n", 1)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"WARC-Target-URI: http://h/p" in head
    assert body == "<b>é</b>".encode() + b"\r\n\r\n" and b"Content-Length: 9" in head


def brute_url_rule(url, rules):
    host, path = url_filter.split_url(url)
    fits = [r for r in rules if host.split(".")[-len(r[0].split(".")) :] == r[0].split(".") and path[: len(r[1])] == r[1]]
    return "".join(min(fits, key=lambda r: (-len(r[0] + r[1]), r))[:2]) if fits else None


def test_url_rules_against_brute_force(spark):
    rng = random.Random(9)
    part = lambda: rng.choice(["a", "b", "A", "org", "com", "x-y"])
    rules = [("com", "/", "block"), ("a.com", "/", "allow"), ("b.a.com", "/a", "block"), ("com", "/a/b", "allow"), ("org", "/a", "block"), ("a.org", "", "allow")]
    urls = [rng.choice(["http://", "", "ftp://x://", "http://b.", "http://b.A."]) + ".".join([*(part() for _ in range(rng.randint(0, 2))), rng.choice(["com", "org", "x"])]) + "".join(rng.choice("//?#") + part() for _ in range(rng.randint(0, 4))) for _ in range(3000)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = url_filter.judge(pages, rules=rules).collect()
    verdicts = {h + p: v for h, p, v in rules}
    w = url_filter.train(url_filter.labelled_urls())
    assert len({r.rule for r in got}) == len(rules) + 1
    for r in got:
        host, path = url_filter.split_url(urls[r.page_id])
        g = sorted(url_filter.grams(host, path))
        assert (r.host, r.path, r.rule) == (host, path, brute_url_rule(urls[r.page_id], rules))
        assert r.model_score == pytest.approx(1 / (1 + np.exp(-(w[g].sum() / np.sqrt(max(1, len(g))) + w[-1]))))
        assert r.verdict == (verdicts[r.rule] if r.rule else "block" if r.model_score >= 0.5 else "allow")


def test_url_rules_and_model(spark):
    urls = [None, "no scheme", "http://EXAMPLE.org/es/1", "https://a.example.org/en/12?x", "http://x.org", "http://x.org/", "http://y.com/de/", "http://y.com/fr/#f", "http://m.poker-night.example.net/en/1", "http://blog.station.example.net/en/1", "ftp://netorg/"]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    for i, u in enumerate(urls):
        assert (got[i].host, got[i].path) == url_filter.split_url(u)
        assert got[i].rule == brute_url_rule(u, url_filter.RULES)
    assert [got[i].rule for i in range(11)] == [None, None, "example.org/es/", "example.org/en/1", None, "org/", "com/de/", "com/fr/", None, None, None]
    assert [got[i].verdict for i in (0, 1, 2, 3, 5, 6, 7, 8, 9)] == ["allow", "allow", "block", "block", "allow", "block", "allow", "block", "allow"]


def test_url_model_on_held_out_urls():
    """Known words with partners, hosts and paths that were held out; then hosts that share no name with the table, and paths alone."""
    rows = url_filter.labelled_urls()
    score = lambda w, u: w[sorted(g := url_filter.grams(*url_filter.split_url(u)))].sum() / np.sqrt(max(1, len(g))) + w[-1]
    w = url_filter.train([r for i, r in enumerate(rows) if i % 5])
    held = [r for i, r in enumerate(rows) if i % 5 == 0]
    assert sum((score(w, u) > 0) == bool(y) for u, y in held) / len(held) > 0.95
    w = url_filter.train(rows)
    assert score(w, "https://qqq.zz/bonus/claim") > score(w, "https://qqq.zz/articles/2021/05/review")
    assert all(score(w, u) > 0 for u in ("http://a.megacasino.zz/x/1", "https://adserver7.zz/", "http://pokerspot.zz/en/3")) and all(score(w, u) < 0 for u in ("http://a.gardeners.zz/x/1", "https://kqz.zz/en/3", "http://historybook.zz/"))


def test_licences(spark):
    full = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nReleased under the MIT License.\nThe software is provided \"as is\", without warranty of any kind, express or implied."
    texts = [(0, None), (1, ""), (2, "Released under the MIT License."), (3, full), (4, "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0."), (5, "The software is provided as is without warranty of any kind express or implied")]
    got = {r.doc_id: (r.rules, r.licenses) for r in licenses.scan(docs_of(spark, texts)).collect()}
    assert got == {0: ("", ""), 1: ("", ""), 2: ("mit-line", "MIT"), 3: ("mit-full,mit-line", "MIT"), 4: ("apache-line,cc-by-nc-line", "Apache-2.0,CC-BY-NC-4.0"), 5: ("", "")}


MIT = """MIT License

Copyright (c) 2024 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE."""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License."""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,"""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE."""
CLAUSE = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS"""


def test_genuine_licences(spark):
    want = [(MIT, "mit-full", "MIT"), (APACHE, "apache-header", "Apache-2.0"), (GPL, "gpl3-header", "GPL-3.0-or-later"), (BSD2, "bsd2", "BSD-2-Clause"), (BSD2.replace("\nTHIS", CLAUSE, 1), "bsd3", "BSD-3-Clause")]
    want = [x for t, r, lic in want for x in ((t, r, lic), (t.replace("\n", "\r\n"), r, lic), ("Some | text ~\n" + t, r, lic))]
    want += [("x\nReleased under the MIT License\nimport os", "mit-line", "MIT"), ("Released under the\n\nMIT License", "", ""), ("Released under the MIT License here", "", "")]
    got = {r.doc_id: (r.rules, r.licenses) for r in licenses.scan(docs_of(spark, [(i, t) for i, (t, _, _) in enumerate(want)])).collect()}
    assert got == {i: (r, lic) for i, (_, r, lic) in enumerate(want)}


def test_licences_of_a_table_of_ones_own(spark):
    sentences = [(1, "you may do anything"), (2, "keep this | and that"), (2, "keep this notice")]
    rules = [("free", "F", [1]), ("free-notice", "FN", [1, 2])]
    texts = ["You may do anything.", "You may do\nanything. Other words.\nKeep this: and that.", "Keep this notice. You may do anything", "Keep this notice."]
    got = {r.doc_id: (r.sentence_ids, r.rules, r.licenses) for r in licenses.scan(docs_of(spark, list(enumerate(texts))), sentences, rules).collect()}
    assert got == {0: ("1", "free", "F"), 1: ("1,2", "free-notice", "FN"), 2: ("2,1", "free", "F"), 3: ("2", "", "")}


def auc(score, label):
    order = np.argsort(np.argsort(score, kind="stable")) + 1
    pos = np.asarray(label) == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize("name,column,folds,held,least", [("op2_toxicity", "toxic", 3, 1, 0.85), ("op10_quality_ranking", "quality", 4, 2, 0.97)])
def test_held_out_accuracy(spark, name, column, folds, held, least):
    sf = "/root/testdata/sf0.01"
    got = queries.queries()[name](spark, sf).toPandas()
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % folds == held for i in got.doc_id]
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    both = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    both = both[both.held_out]
    assert auc(both.score, both[column]) > least


def test_classifiers_on_edges(spark, edge):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(11)], none.schema)
    for labels in (none, some):
        assert quality_ranker.rank(edge, labels).count() == 12 and toxicity.score(edge, labels).count() == 12
        assert quality_ranker.keep_good(edge, labels).columns == edge.columns
    assert quality_ranker.rank(edge.limit(0), some).count() == 0 and toxicity.score(edge.limit(0), some).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name.replace(" ", "-"))
        stage(spark, before, SF).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == columns and 0 < after.count() <= before.count()
        text = lambda df: [(r.doc_id, r.text) for r in df.collect()]
        if name == "quality rules":
            assert {i for i, _ in text(after)} == {i for i, t in text(before) if not failed(t)}
        if name == "near duplicates":
            comp = jaccard_components(text(before), 5, 80)
            assert {i for i, _ in text(after)} == {i for i, (_, c) in comp.items() if c == i}
        if name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            hits = {i: brute_hits(t, items) for i, t in text(before)}
            assert {i for i, _ in text(after)} == {i for i, h in hits.items() if not (h[1] > 0 and 20 * h[1] >= h[0])}
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in before.collect()}


def failed(text):
    n, chars, symbols, dup, rep = brute_rules(text)
    lines = len([x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")])
    return n < 10 or 100 * rep > 20 * n or 2 * symbols > n or 2 * dup > lines or chars < 2 * n or chars > 40 * n or 2 * (text or "").count("!") > n


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = queries.queries()[name](spark, SF)
    key = lambda rows: sorted(map(repr, rows))
    assert key(tuple(r) for r in got.select(*names).collect()) == key(want.fetchall())


def test_rows_are_hashable(edge):
    assert isinstance(edge.select(F.lit(1)).first(), Row)


def test_warc_revisits_and_identifiers(spark, tmp_path):
    rows = [(1, "u\x00\x1f\x7f\té", "same"), (2, "v", "same"), (2, "v", "same"), (9, "w", "other"), (9, "w", "third"), (None, None, "same")]
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = warc.read_archive(spark, str(tmp_path / "w")).collect()
    heads = [dict(line.split(": ", 1) for line in bytes(r.record).split(b"\r\n\r\n")[0].decode().split("\r\n")[1:]) for r in got]
    names = [h["WARC-Record-ID"] for h in heads]
    assert len(set(names)) == len(rows)
    for r, h in zip(got, heads, strict=True):
        body = bytes(r.record).split(b"\r\n\r\n", 1)[1]
        assert body == (b"" if r.record_type == "revisit" else bytes(r.payload)) + b"\r\n\r\n"
        assert int(h["Content-Length"]) == len(body) - 4
        assert (r.record_type == "revisit") == ("WARC-Profile" in h) == ("WARC-Refers-To" in h)
        if r.record_type == "revisit":
            assert names.index(h["WARC-Refers-To"]) >= 0 and heads[names.index(h["WARC-Refers-To"])]["WARC-Payload-Digest"] == h["WARC-Payload-Digest"]
    assert [h["WARC-Target-URI"] for r, h in zip(got, heads, strict=True) if r.page_id == 1] == ["u%00%1F%7F%09é"]
    assert sorted((r.page_id, bytes(r.payload)) for r in got if r.record_type == "response" and r.page_id) == [(2, b"same"), (2, b"same"), (9, b"other"), (9, b"third")]


def test_near_duplicates_of_repeated_rows(spark, monkeypatch):
    """Repeats add rows, not pairs: what is written for one pair of near copies is the same for 200 repeats of each."""
    a = [f"w{i}" for i in range(60)]
    b = [*a[:59], "x"]
    written = []

    def counted(df, label, under=None):
        out = keep(df, label, under)
        written.append((label, out.count()))
        return out

    keep = near_dup.stored
    monkeypatch.setattr(near_dup, "stored", counted)
    sizes = {}
    for n in (1, 200):
        written.clear()
        docs = docs_of(spark, [(i % 2, " ".join(b if i % 2 else a)) for i in range(2 * n)])
        got = near_dup.near_duplicates(docs).collect()
        assert len(got) == 2 * n and {r.component_id for r in got} == {0}
        sizes[n] = [x for x in written if x[0] != "minhash"]
        assert near_dup.keep_one(docs).select("doc_id").collect() == [(0,)]
    assert sizes[1] == sizes[200]


def test_rows_that_share_a_doc_id(spark):
    long = lambda p: " ".join(f"{p}{i}" for i in range(30))
    docs = docs_of(spark, [(7, long("a")), (7, long("b")), (3, long("b")), (None, long("c")), (None, long("c")), (None, long("a")), (5, None), (5, None), (None, ""), (9, long("d"))])
    got = sorted(((r.doc_id, r.component_id) for r in near_dup.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(7, 7), (7, 3), (3, 3), (None, None), (None, None), (None, 7), (5, 5), (5, 5), (None, None), (9, 9)], key=repr)
    kept = sorted(((r.doc_id, r.text) for r in near_dup.keep_one(docs).collect()), key=repr)
    assert kept == sorted([(7, long("a")), (3, long("b")), (None, long("c")), (5, None), (5, None), (None, ""), (9, long("d"))], key=repr)


CLASH = ["a.b", "TEXT2", "kept_id", "bad_id", "row", "c0", "c1", "d", "digest", "rep", "gone", "many", "label", "lid", "spans", "`q`", "raw", "score", "comp", "ids", "words", "number", "host", "first_id"]


@pytest.fixture(scope="module")
def worst(spark, edge_texts):
    """Rows with nulls in any column, repeats, one very long text, and columns named like everything used inside."""
    texts = [*edge_texts, *edge_texts[-3:], (None, None), (None, " ".join(f"w{i % 9000}" for i in range(60_000))), (40, "plain sentences about rivers and towns with many different words in them")]
    rows = [(i, t, None if n % 2 else "en", *[None if (n + j) % 3 else f"v{j}" for j in range(len(CLASH))]) for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "lang string", *[f"`{c.replace('`', '``')}` string" for c in CLASH]]))


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "rules", "classifier", "near duplicates", "decontamination"])
def test_worst_rows(spark, worst, name):
    """Every operator and stage on the worst rows and on an empty table: as many rows as it defines, and no crash."""
    n = worst.count()
    labels = spark.createDataFrame([(i, i % 2, i % 2, "x") for i in range(11)] + [(None, 1, 1, None), (3, None, None, "y")], "doc_id long, quality int, toxic int, `a.b` string")
    bench = spark.createDataFrame([(1, "double spaces and lines", "r"), (None, "double spaces and lines", None), (None, None, None), (4, "", "z")], "item_id long, text string, `spans` string")
    pages = worst.withColumnsRenamed({"doc_id": "page_id", "text": "html"}).withColumn("url", F.concat(F.lit("http://h/"), "html"))
    run = {
        "op1": (lambda d: quality_rules.store(d), n), "op2": (lambda d: toxicity.score(d, labels), n), "op3": (lambda d: url_filter.judge(d.withColumn("page_id", F.col("doc_id")).withColumn("url", F.col("text"))), n),
        "op4": (lambda d: token_counts.token_counts(d), n), "op5": (lambda d: decontam.scan_documents(d, bench), n), "op6": (lambda d: warc.round_trip(pages if d is worst else pages.limit(0)), n),
        "op7": (lambda d: near_dup.near_duplicates(d), n), "op8": (lambda d: licenses.scan(d), n), "op9": (lambda d: packing.pack(d).select("doc_id", "doc_tokens").distinct(), None), "op10": (lambda d: quality_ranker.rank(d, labels), n),
        "rules": (quality_rules.keep_good, None), "classifier": (lambda d: quality_ranker.keep_good(d, labels), None), "near duplicates": (near_dup.keep_one, None), "decontamination": (lambda d: decontam.drop_contaminated(d, bench), None),
    }
    f, rows = run[name]
    got = f(worst)
    kept = got.collect()
    assert kept and rows in (None, len(kept))
    assert f(worst.limit(0)).count() == 0
    if not name.startswith("op"):
        assert got.columns == worst.columns
        before = [tuple(r) for r in worst.collect()]
        assert all(tuple(r) in before for r in kept) or name == "decontamination"
    if name == "op5":
        assert {(r.n_hit, r.n_items) for r in kept if r.doc_id == 9} == {(4, 2)}


def test_benchmark_blocks_hold_every_window():
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice(["a", "bb", "ccc", "d4"]) for _ in range(n)).encode()) for i, n in enumerate([0, 3, 13, 14, 40, 300])]
    for size in (1, 20, 100, 10**6):
        blocks = decontam.cut_into_blocks(items, size)
        assert all(sum(len(t) for _, t in b) <= max(size, 14 * 4) for b in blocks)
        windows = lambda rows: {(i, tuple(w[j : j + min(13, len(w))])) for i, t in rows if (w := decontam.words_of(t)) for j in range(max(1, len(w) - 12))}
        assert windows([x for b in blocks for x in b]) == windows(items)


def test_label_model_estimates_rates():
    rng = np.random.default_rng(6)
    y = rng.random(6000) < 0.2
    p1, p0 = np.array([0.7, 0.5, 0.6, 0.4, 0.8, 0.3]), np.array([0.05, 0.02, 0.1, 0.01, 0.2, 0.02])
    votes = (rng.random((6000, 6)) < np.where(y[:, None], p1, p0)).astype(float)
    votes = np.concatenate((votes, votes[:, :1]), axis=1)  # the first voter twice
    label = np.where(rng.random(6000) < 0.25, np.where(rng.random(6000) < 0.1, ~y, y).astype(int), -1)
    got = toxicity.label_model(votes, label)
    assert np.abs(got["rates"][:6, 0] - p1).max() < 0.08 and np.abs(got["rates"][:6, 1] - p0).max() < 0.04
    assert got["rates"][-1] == pytest.approx([0.9, 0.1], abs=0.06) and abs(got["prior"] - 0.2) < 0.04
    assert got["weight"][0] == pytest.approx(0.5, abs=0.05) and got["weight"][6] == got["weight"][0] and (got["weight"][1:6] > 0.9).all()
    assert ((got["posterior"] > 0.5) == y).mean() > 0.95


def test_voters_are_reported(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.voters(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert got[-1].voter == "known label" and got[-1].rate_toxic > 0.5 > got[-1].rate_clean
    words = [r for r in got if r.voter.startswith("w:") and not r.voter.endswith("twice")]
    assert words and sum(r.rate_toxic > r.rate_clean for r in words) >= 0.9 * len(words)
    assert all(0 <= r.rate_clean <= 1 and 0 < r.weight <= 1 for r in got)


def test_quantile_follows_the_corpus():
    """The level is the corpus's own share of low documents, not the labels'."""
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(0, 1, (300, 2)), rng.normal(4, 1, (300, 2))))
    model = quality_ranker.fit(x, np.repeat([0, 1], 300))
    for share in (0.0, 0.02, 0.5, 0.9):
        n = int(20_000 * share)
        s = np.concatenate((rng.normal(0, 1, (n, 2)), rng.normal(4, 1, (20_000 - n, 2)))) @ model["w"] - model["c"]
        counts, edges = np.histogram(np.clip(s, model["low"], model["high"]), quality_ranker.BINS, (model["low"], model["high"]))
        found = quality_ranker.low_share(model, (edges[1:] + edges[:-1]) / 2, counts)
        assert abs(found - share) < 0.01
        cut = quality_ranker.quantile(edges, counts, found)
        assert abs((s < cut).mean() - share) < 0.015
    assert quality_ranker.quantile(np.arange(5.0), np.array([2, 0, 0, 2]), 0.5) == 2.0


def naive_features(text):
    """The ranker's features, one by one."""
    t = (text or "").encode()
    w = re.findall(rb"[^ \t\n\r\x0b\x0c]+", t)
    n = len(w)
    if not n:
        return [0.0] * 14
    count = lambda chars: sum(c in chars for c in t)
    symbols, shout = count(b"#*$%&|<>") / n, count(b"!") / n
    up, low = sum(65 <= c <= 90 for c in t), sum(97 <= c <= 122 for c in t)
    same = sum(a == b for a, b in zip(w, w[1:], strict=False)) / n
    windows = [tuple(w[i : i + 5]) for i in range(n - 4)]
    again = 1 - len(set(windows)) / len(windows) if windows else 0.0
    lines = [x for x in t.split(b"\n") if x.strip()]
    upper = up / (up + low + 1)
    return [min(symbols, 2), min(symbols, 0.3), min(shout, 2), min(shout, 0.3), upper, min(upper, 0.2), same, min(same, 0.1), again, min(again, 0.2), 1 - len(set(lines)) / len(lines), len(set(w)) / n, min(len(t) / n, 30) / 10, 1 / (1 + n)]


def test_ranking_against_plain_arithmetic(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").toPandas(), spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    x = np.array([naive_features(t) for t in docs.text])
    known = {i: q for i, q in zip(labels.doc_id, labels.quality, strict=True) if zlib.crc32(str(i).encode()) % 4 != 2}
    rows = sorted((i, known[i], x[k].tolist()) for k, i in enumerate(docs.doc_id) if i in known)
    model = quality_ranker.fit(np.array([r[2] for r in rows]), np.array([r[1] for r in rows]))
    raw = x @ model["w"] - model["c"]
    counts, edges = np.histogram(np.clip(raw, model["low"], model["high"]), quality_ranker.BINS, (model["low"], model["high"]))
    cut = quality_ranker.quantile(edges, counts, quality_ranker.low_share(model, (edges[1:] + edges[:-1]) / 2, counts))
    got = queries.queries()["op10_quality_ranking"](spark, sf).toPandas().set_index("doc_id").loc[docs.doc_id]
    clear = np.abs(raw - cut) > 1e-6 * model["spread"]
    assert (got.predicted.to_numpy() == (raw >= cut))[clear].all() and clear.mean() > 0.99
    assert (np.argsort(got.score.to_numpy()[raw >= cut], kind="stable") == np.argsort(raw[raw >= cut], kind="stable")).mean() > 0.99


def test_toxicity_against_plain_counts(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    terms, w, _ = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    for r in docs.collect():
        words = re.findall(r"[^\W\d_]+", (r.text or "").lower())
        hits = lambda t, x: x == t[2:] if t[0] == "w" else x.startswith(t[2:]) and len(x) > len(t) - 2
        own = [sum(hits(t, x) for x in words) for t in terms]
        total, n = sum(any(hits(t, x) for t in terms) for x in words), len(words)
        row = [*np.log1p(own), np.log1p(total), min(total, 1), min(total, 3) / 3, total / (n + 20) * 20, *(float(total * d < n) for d in (400, 100, 50)), 1.0]
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-np.dot(row, w))), abs=1e-9)
