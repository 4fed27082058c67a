"""Every corpus operator against brute force or an exact property, and on awkward rows."""

import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.llm import kernels as K
from tidewater.llm import ann, cells, common, decontaminate, hmm, langid, licences, line_dedup, ngram_join, pieces, secrets, wrappers
from tidewater.llm.common import components

ASCII_LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
#: Columns that every operator may meet besides its own, with names that it might use itself.
CLASHING = ", key string, vid string, n string, value string, score string, lang_pred string, n_words string, ids string, base string, `a b` string, __gone string"
CLASH = ("k", "v", "n", "x", "s", "l", "w", "i", "b", "ab", "g")


def documents(spark, rows, clash=False):
    """rows: (doc_id, text[, lang[, source]])."""
    full = [(r + (None, None))[:4] for r in rows]
    full = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in full]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    if clash:
        return spark.createDataFrame([r + CLASH for r in full], schema + CLASHING)
    return spark.createDataFrame(full, schema)


LONG = " ".join(f"word{i % 977} tail{i}" for i in range(60000))
AWKWARD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (6, LONG), (6, LONG), (None, "null id one two three four"), (None, None), (7, "é🙂\x00 ünï code"), (8, LONG)]


def text_of(rng, vocabulary, n):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Texts with exact copies, near copies, shared passages and singletons."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeghilmnorst") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    out = []
    for g in range(40):
        base = text_of(rng, vocabulary, rng.randint(3, 160)).split(" ")
        for _ in range(rng.choice((1, 1, 2, 5))):
            words = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 6))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append("\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9)))
    return list(enumerate(out))


# Connected components


def test_components_are_exact(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    got = {r["v"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {v: top(v) for e in edges for v in e if top(v) != v}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1: secrets


def test_few_links_take_no_shuffle(spark, monkeypatch):
    """Few links are solved by one task, more of them by joins, with one result."""
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1200)]
    edges = spark.createDataFrame(links, "a long, b long")
    few = components(edges)
    assert "Exchange" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(common, "FEW_EDGES", 10)
    assert {tuple(r) for r in few.collect()} == {tuple(r) for r in components(edges).collect()}
    assert components(edges.limit(0)).count() == 0


def brute_base(text):
    found = []
    for kind, pattern in enumerate((r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", r"AKIA[A-Z0-9]+", r"[0-9a-f]+")):
        for m in re.finditer(pattern, text or ""):
            if (kind == 0 and len(m[2]) >= 6) or (kind == 1 and len(m[0]) >= 20) or (kind == 2 and len(m[0]) >= 24):
                found.append((m.start(), kind, m.end()))
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_secret_scan(spark):
    texts = ["é🙂 password=abcdef123 x", "Token: 'short' secret = \"longenough\"", "AKIA" + "Q" * 15, "AKIA" + "Q7" * 9 + " tail", "a" * 40 + "g" + "0f" * 12, "secret=token:abcdef", "passwd==x api_key:zzzzzz apikey=yyyyyyy", None, ""]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)] + AWKWARD
    rows += [(100 + i, "copied Zq8Zq7Xw6Xv5Uu4Tt3Ss2Rr1 here", "en", f"s{i}") for i in range(4)] + [(200, "owned Pp8Zq7Xw6Xv5Uu4Tt3Ss2Rr1Q here", "en", "s1")]
    docs = documents(spark, rows, clash=True)
    got = secrets.secret_scan(docs).collect()
    assert len(got) == len(rows)
    said = Counter((r["doc_id"], ",".join(f"{secrets.KINDS[b['kind']]}:{b['start']}:{b['end']}" for b in r["base"])) for r in got)
    assert said == Counter((r[0], brute_base(r[1])) for r in rows)
    live = {r["doc_id"]: [(s["start"], s["end"]) for s in r["live"]] for r in got}
    assert live[200] == [(6, 31)] and all(live[100 + i] == [] for i in range(4))
    assert {r["doc_id"]: r["n_copied"] for r in got}[100] == 1
    assert secrets.secret_scan(documents(spark, [])).count() == 0


# 2: licences


def test_licence_scan(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [
        (20, f"Some code.\nCopyright (c) 2020 Someone\n\n{mit}\nmore prose"),
        (21, "Text. Licensed under the Apache License, Version 2.0. Bye"),
        (22, "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
        (23, "SPDX-License-Identifier: MPL-2.0\nOther license words"),
        (24, "Copyright 1999 X.\nAll rights reserved."),
        *AWKWARD,
    ]
    wrapped = ["\n".join(textwrap.wrap(x, 50)) for x in mit.split("\n\n")]
    rows.append((25, "\n\n".join(wrapped)))
    gate = re.compile(licences.GATE)
    assert all(gate.search(x) for x in licences.SENTENCES)
    got = {r["doc_id"]: (r["licences"], r["n_unknown"]) for r in licences.recognise(documents(spark, rows, clash=True)).collect()}
    assert got[20][0] == got[25][0] == ["MIT"] and got[21] == (["Apache-2.0"], 0) and got[22][0] == ["GPL-3.0-or-later"]
    assert got[23] == (["MPL-2.0"], 1) and got[24][0] == ["Proprietary"] and got[1] == ([], 0) and got[2] == ([], 0)
    assert licences.recognise(documents(spark, [])).count() == 0


# 3: lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@given(st.text("abc", max_size=14), st.text("abc", max_size=14), st.integers(0, 4))
@settings(max_examples=400, deadline=None)
def test_banded_distance(a, b, k):
    assert line_dedup.within(a, b, k) == (distance(a, b) <= k)
    assert line_dedup.within("x" * 130 + a + "y" * 70, "x" * 130 + b + "y" * 70, k) == (distance("x" * 130 + a + "y" * 70, "x" * 130 + b + "y" * 70) <= k)


def may_differ(shorter, grows=True):
    return shorter // 20 if grows and shorter >= 60 else 2


def brute_lines(rows, shortest=1, grows=True):
    """{(row, pos): (keep_doc, keep_pos)} of the removed lines of rows (row, doc_id, text), a row being a hash of both others."""
    places, doc_of = {}, {r: i for r, i, _ in rows}
    for r, i, t in rows:
        for pos, line in enumerate([] if t is None else t.split("\n")):
            if len(line) >= shortest:
                places.setdefault(line, set()).add((i is None, i or 0, r, pos))
    lines, up = sorted(places, key=len), {x: x for x in places}
    counts = [Counter(x) for x in lines]

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, a in enumerate(lines):
        m = n - 1
        while m >= 0 and len(lines[m]) >= 24 and len(a) - len(lines[m]) <= max(2, len(a) // 20):
            b, may = lines[m], may_differ(len(lines[m]), grows)
            if len(a) - len(b) <= may and sum((counts[n] - counts[m]).values()) <= may and distance(a, b) <= may:
                up[top(a)] = top(b)
            m -= 1
    classes = {}
    for x in lines:
        classes.setdefault(top(x), set()).update(places[x])
    first = {x: min(v) for x, v in classes.items()}
    return {p[2:]: (doc_of[first[x][2]], first[x][3]) for x, v in classes.items() for p in v if p != first[x]}


def row_ids(docs):
    return [tuple(r) for r in docs.select(line_dedup.row_id("doc_id", "text"), "doc_id", "text").collect()]


def without(rows, gone):
    """The texts of rows that removing lines leaves; (doc_id, text) of each row that stays."""
    lost = {}
    for r, pos in gone:
        lost.setdefault(r, set()).add(pos)
    out = Counter()
    for r, i, t in rows:
        left = t if r not in lost else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in lost[r])
        if r not in lost or left.strip("\n"):
            out[(i, left)] += 1
    return out


def removed_lines(gone):
    return {(r["rid"], g["pos"]): (g["keep_doc"], g["keep_pos"]) for r in gone.collect() for g in r["gone"]}


def test_line_dedup(spark, corpus):
    rng = random.Random(5)
    rows = list(corpus) + AWKWARD
    lines = sorted({x for _, t in corpus for x in t.split("\n") if len(x) > 20})[:60]
    for n, x in enumerate(lines):
        for m in range(3):
            y = list(x)
            for _ in range(rng.randint(0, 3)):
                op, at = rng.randrange(3), rng.randrange(len(y))
                y[at : at + (op != 0)] = [] if op == 2 else [rng.choice("aäz🙂")]
            rows.append((1000 + 10 * n + m, "".join(y) + "\nshort\n"))
    top = (1 << 63) - 1
    rows += [(5, f"{lines[0]}\nonly this row of document 5 has this line of text"), (None, f"{lines[1]}\nonly one null row has this line of text"), (None, f"{lines[1]}\nthe other null row has this"), (top, f"{lines[2]}\nthe largest of ids")]
    docs = documents(spark, rows, clash=True)
    named = row_ids(docs)
    for equal_short in (True, False):
        counted, gone = line_dedup.line_classes(docs, equal_short)
        assert removed_lines(gone) == brute_lines(named, 1 if equal_short else 24)
    assert Counter((r["doc_id"], r["n_lines"]) for r in counted.collect()) == Counter((r[0], 0 if r[1] is None else len(r[1].split("\n"))) for r in rows)
    kept = line_dedup.dedup_lines(docs, False, line_dedup.NEVER)
    assert kept.columns == docs.columns
    texts = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert texts == without(named, brute_lines(named, 24, False))
    for i, line in ((5, "only this row of document 5 has this line of text"), (None, "only one null row has this line of text"), (None, "the other null row has this"), (top, "the largest of ids")):
        assert any(d == i and t and t.endswith(line) for d, t in texts)
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


@given(st.lists(st.tuples(st.text("abc", max_size=12), st.text("abc", max_size=12), st.integers(0, 9)), min_size=1, max_size=30))
@settings(max_examples=100, deadline=None)
def test_edit_distances_in_step(pairs):
    pairs = [(a + "x" * 40 + b, b + "x" * 40 + a, k) for a, b, k in pairs] * 4
    a, b, k = zip(*pairs, strict=True)
    got = line_dedup.all_within(list(a), list(b), np.array(k))
    assert got.tolist() == [distance(x, y) <= n for x, y, n in pairs]


def test_edit_distances_of_any_symbols():
    rng = random.Random(6)
    for alphabet in ("ab", "abcdef gh", [chr(0x4E00 + i) for i in range(600)], [chr(0x10000 + i) for i in range(70000)]):
        a = ["".join(rng.choice(alphabet) for _ in range(rng.choice((0, 1, 40, 400)))) for _ in range(60)]
        b = ["".join(x if rng.random() < 0.97 else rng.choice(alphabet) for x in t) + rng.choice(("", "x", "xyz")) for t in a]
        k = np.array([rng.randrange(40) for _ in a])
        assert line_dedup.all_within(a, b, k).tolist() == [line_dedup.within(x, y, int(n)) for x, y, n in zip(a, b, k, strict=True)]


def test_blocks_of_short_lines_are_wide(spark):
    """A bucket's rows grow with its square only beyond WIDE lines, or fewer long ones."""
    row = F.lit(12 << 55).alias("key"), F.col("id").alias("vid")
    members = spark.range(1000).select(*row).select("*", line_dedup.block_of("key"))
    assert cells.spread(cells.cells_of(members, "size")).count() == 1000
    kinds = spark.createDataFrame([(0,), (len(line_dedup.CLASSES) - 1,), (line_dedup.SHORT,)], "kind long").select(F.shiftleft("kind", 55).alias("key"))
    assert [r["size"] for r in kinds.select(line_dedup.block_of("key")).collect()] == [line_dedup.WIDE, cells.BLOCK, line_dedup.WIDE]


def test_line_buckets_beyond_one_block(spark):
    """More lines that share a segment than a block holds still meet, whichever block they are in."""
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh") for _ in range(40))
    rows = [(i, base + f"{i:06d}" + base[::-1]) for i in range(0, 3000, 7)]
    docs = documents(spark, rows)
    got = removed_lines(line_dedup.line_classes(docs)[1])
    up = {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = [i for i, _ in rows]
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if distance(f"{i:06d}", f"{j:06d}") <= may_differ(86):
                up[max(top(i), top(j))] = min(top(i), top(j))
    assert got == {(r, 0): (top(i), 0) for r, i, _ in row_ids(docs) if top(i) != i}


def test_lines_that_share_one_segment(spark):
    """By chance, they meet in no bucket; with as many edits as may be, one in each other segment, they are linked, whichever half of a segment an edit is in."""
    rng = random.Random(31)

    def some(n):
        return [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)]

    chance, linked = [], []
    for n in (130, 240, 900):
        c = int(line_dedup.CHUNKS[line_dedup.length_class(np.array([n]))[0]])
        for j in (1, 3, n // 20):
            shared = some(c)
            chance += ["".join(some(j * c) + shared + some(n - j * c - c)) for _ in range(2)]
            for place in (0, 1, c // 2 - 1, c // 2, c - 1):
                for op in range(3):
                    a = some(n)
                    b = list(a)
                    for i in reversed(range(n // 20 + 1)):
                        if i != j:
                            p = i * c + place
                            b[p : p + (op != 0)] = [] if op == 2 else ["#"]
                    linked.append(("".join(a), "".join(b)))
    docs = spark.createDataFrame([(x,) for x in chance], "text string")
    assert line_dedup.bucket_members(docs, 1000, line_dedup.LONG).count() == 0
    docs = documents(spark, [(2 * i + k, x) for i, pair in enumerate(linked) for k, x in enumerate(pair)])
    doc = {r: i for r, i, _ in row_ids(docs)}
    got = {doc[r]: k[0] for (r, _), k in removed_lines(line_dedup.line_classes(docs)[1]).items()}
    within = [i for i, (a, b) in enumerate(linked) if line_dedup.within(a, b, may_differ(min(len(a), len(b))))]
    assert len(within) > 100 and got == {2 * i + 1: 2 * i for i in within}


@pytest.mark.parametrize("long", [line_dedup.LONG, line_dedup.NEVER])
def test_keys_in_shares(spark, monkeypatch, long):
    """Keys are looked at a bounded number at a time, whatever the size of the table, and each of them once."""
    rng = random.Random(41)
    rows = []
    for n in [*range(24, 64, 3), 60, 61, 62, 66, 67, *[100] * 20, 105, 109, 110, 115, 300, 420, 441]:
        line = [rng.choice("abcdefghijklmnopqrstuvwxyzäß🙂") for _ in range(n)]
        rows.append("".join(line))
        for _ in range(2):
            y = list(line)
            for _ in range(rng.randint(1, 3)):
                op, at = rng.randrange(3), rng.randrange(len(y))
                y[at : at + (op != 0)] = [] if op == 2 else [rng.choice("AÄ🙂")]
            rows.append("".join(y))
    rng.shuffle(rows)
    docs = documents(spark, [(i, "\n".join(rows[5 * i : 5 * i + 5])) for i in range(len(rows) // 5)])
    members = Counter(tuple(r) for r in line_dedup.bucket_members(docs.select("text"), 10000, long).collect())
    removed = removed_lines(line_dedup.line_classes(docs, long=long)[1])
    at_once, one = [], line_dedup.bucket_members

    def counting(texts, n_keys, long, share):
        at_once.append(n_keys)
        assert sum(len(line_dedup.Lines(*K.utf8(pa.array([r["text"]], pa.string())), long, share).index_keys(np.arange(r["text"].count("\n") + 1))[1]) for r in texts.collect()) <= 2 * 60
        return one(texts, n_keys, long, share)

    monkeypatch.setattr(line_dedup, "KEYS_AT_ONCE", 60)
    monkeypatch.setattr(line_dedup, "SHARES", 1 << 30)
    monkeypatch.setattr(line_dedup, "bucket_members", counting)
    lines = line_dedup.by_length(docs.select("text").repartition(1), long)
    assert Counter(tuple(r) for r in common.read_together(line_dedup.all_members(lines, long)).collect()) == members and max(members.values()) == 1
    assert len(at_once) >= 8 and max(at_once) <= 60
    monkeypatch.setattr(line_dedup, "KEYS_AT_ONCE", 400)
    monkeypatch.setattr(line_dedup, "bucket_members", one)
    assert removed_lines(line_dedup.line_classes(docs, long=long)[1]) == removed and len(removed) > 20


def test_line_distance_grows_with_length(spark):
    """Against brute force: what may differ grows with the shorter line, and pairs on both sides of each bound are told apart."""
    rng = random.Random(12)
    lines = []
    for n in (24, 40, 58, 59, 60, 61, 79, 80, 125, 198, 240, 420):
        for _ in range(3):
            base = [rng.choice("abcdefghijklmnop qrstuvwxyz") for _ in range(n)]
            lines.append("".join(base))
            may = int(line_dedup.allowed(np.int64(n)))
            for edits in (may - 1, may, may + 1, may + 2):
                y = list(base)
                for _ in range(edits):
                    op, at = rng.randrange(3), rng.randrange(len(y))
                    y[at : at + (op != 0)] = [] if op == 2 else [rng.choice("AÄZ🙂")]
                lines.append("".join(y))
    word = "one line of words with a single word that is later put in place of another one and that is all there is to say about this line of words"
    lines += [word, word.replace("single", "quite different")]
    rng.shuffle(lines)
    docs = documents(spark, list(enumerate(lines)))
    doc = {r: i for r, i, _ in row_ids(docs)}
    got = {doc[r]: k[0] for (r, _), k in removed_lines(line_dedup.line_classes(docs)[1]).items()}
    up = list(range(len(lines)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    linked = 0
    for i, a in enumerate(lines):
        for j in range(i):
            shorter = min(len(a), len(lines[j]))
            may = may_differ(shorter)
            if shorter >= 24 and abs(len(a) - len(lines[j])) <= may and distance(a, lines[j]) <= may:
                up[max(top(i), top(j))] = min(top(i), top(j))
                linked += distance(a, lines[j]) > 2
    assert linked > 20
    assert got == {i: top(i) for i in range(len(lines)) if top(i) != i}


def test_links_in_a_large_group_join_it_without_all_pairs():
    """Pairs that links found before have joined are not verified; the groups are those of all pairs."""
    rng = random.Random(21)
    bases = ["".join(rng.choice("abcdefgh ") for _ in range(100)) for _ in range(2)]
    texts = [base[:at] + "X" + base[at + 1 :] for base in bases for at in range(100)] + ["".join(rng.choice("abcdefgh ") for _ in range(100))]
    i, j = np.triu_indices(len(texts), 1)
    ok = line_dedup.near_pairs(texts, i, j, line_dedup.LONG)
    assert np.count_nonzero(ok) < 2 * 4950
    assert all(distance(texts[a], texts[b]) <= 5 for a, b in zip(i[ok][::50].tolist(), j[ok][::50].tolist(), strict=True))
    v, label = common.smallest_reachable(i[ok], j[ok])
    assert dict(zip(v.tolist(), label.tolist(), strict=True)) == {k: k // 100 * 100 for k in range(200)}


def test_pairs_of_large_cells_are_those_of_small_ones(monkeypatch):
    rng = random.Random(22)
    rows = []
    for key, lo, hi, n in ((10, 0, 0, 90), (10, 0, 1, 140), (50, 0, 0, 12), (90, 0, 0, 70)):
        for vid in sorted(rng.sample(range(10000), n)):
            counts = bytes(rng.randrange(3) for _ in range(line_dedup.BINS))
            rows.append((key, lo, hi, vid, rng.choice((lo, hi)), rng.randrange(300, 400), counts, sorted(rng.sample(range(200), 8)), rng.randrange(40)))
    table = pa.table(dict(zip(("key", "lo", "hi", "vid", "blk", "length", "counts", "keys", "label"), map(list, zip(*rows, strict=True)), strict=True)))
    found = []
    for crowd in (1, 64, 1 << 30):
        monkeypatch.setattr(line_dedup, "CROWD", crowd)
        i, j = line_dedup.may_match(table, line_dedup.LONG)
        found.append(sorted((min(x), max(x)) for x in zip(i.tolist(), j.tolist(), strict=True)))
    assert found[0] == found[1] == found[2] and len(found[0]) > 100


def test_equal_sets_of_lines_are_one_bucket(spark):
    """Buckets with lines of several classes, each set of members once, in blocks of their size."""
    rows = [(key, vid, vid % 2, 3) for key in (1, 2) for vid in range(10)] + [(3, vid, vid % 2, 3) for vid in range(9)] + [(4, vid, 5, 3) for vid in range(10)]
    got = spark.createDataFrame(rows, "key long, vid long, label long, size int").transform(line_dedup.mixed_buckets).collect()
    sets = {}
    for r in got:
        sets.setdefault(r["key"], []).append((r["vid"], r["blk"], r["n_blk"]))
    assert sorted(sorted(v for v, _, _ in x) for x in sets.values()) == [[*range(9)], [*range(10)]]
    assert all(n == -(-len(x) // 3) and 0 <= b < n for x in sets.values() for _, b, n in x)


def test_equal_short_lines_are_one_class(spark):
    long = "a line that has more than twenty-four characters"
    rows = [(1, f"Of, edti oner.\n\n{long}\nx"), (2, "Of, edti oner.\n\nOf, edti onerX\nOf, edti oner."), (3, f"x\n{long}!\n🙂"), (4, "🙂"), (5, ""), (6, None)]
    docs = documents(spark, rows)
    doc = {r: i for r, i, _ in row_ids(docs)}
    counted, gone = line_dedup.line_classes(docs)
    got = {(doc[r], pos): k for (r, pos), k in removed_lines(gone).items()}
    assert got == {(2, 0): (1, 0), (2, 3): (1, 0), (3, 0): (1, 3), (3, 1): (1, 2), (4, 0): (3, 2)}
    assert {r["doc_id"]: r["n_lines"] for r in counted.collect()} == {1: 4, 2: 4, 3: 3, 4: 1, 5: 1, 6: 0}


# 4: language model


@pytest.mark.parametrize("head", [1 << 17, 40, 0])
def test_hmm(spark, corpus, monkeypatch, head):
    monkeypatch.setattr(hmm, "HEAD", head)
    rows = list(corpus) + AWKWARD
    got = hmm.score(documents(spark, rows, clash=True)).collect()
    assert len(got) == len(rows)
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = lambda t: re.findall(r"[^ \t-\r]+", (t or "").translate(ASCII_LOWER)) + [None]
    counts = Counter(x for i, t, *_ in rows if not out(i) for x in tokens(t))
    total, size = sum(counts.values()), len(counts)
    want = Counter((i, out(i), len(w := tokens(t)), sum(counts[x] > 0 for x in w), total, round(sum(math.log10((counts[x] + 1) / (total + size + 1)) for x in w), 4)) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    empty = hmm.score(documents(spark, [(13, "only held out") for _ in range(1)] if out(13) else [])).collect()
    assert all(r["train_tokens"] == 0 for r in empty)


@pytest.mark.parametrize("head", [1 << 17, 12])
def test_hmm_words_of_one_letter(spark, monkeypatch, head):
    """A word of one letter is one word, whatever white space or row stands before it."""
    monkeypatch.setattr(hmm, "HEAD", head)
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice(["a", "B", "b", "7", "\x01", "ab", "é", "xyz"]) + rng.choice(" \t\n\r\x0b\x0c") for _ in range(rng.randrange(30)))) for i in range(60)]
    rows += [(60, "a"), (61, "A\na a\ta"), (62, "\n7\n\n7"), (62, "\n7\n\n7"), (None, "\tb"), (-1, "\tb")]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = lambda t: re.findall(r"[^ \t-\r]+", t.translate(ASCII_LOWER)) + [None]
    counts = Counter(x for i, t in rows if not out(i) for x in tokens(t))
    total, size = sum(counts.values()), len(counts)
    docs = documents(spark, rows).repartition(3)
    assert hmm.count_tokens(docs).count() == len({x for _, t in rows for x in tokens(t)})
    got = hmm.score(docs).collect()
    want = Counter((i, out(i), len(w := tokens(t)), sum(counts[x] > 0 for x in w), total, round(sum(math.log10((counts[x] + 1) / (total + size + 1)) for x in w), 6)) for i, t in rows)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want


def test_hmm_recursions_agree_with_enumeration():
    rng = np.random.default_rng(2)
    start, step, emit = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(4), 3).T
    sequence = [0, 3, 1, 1, 2]
    total = 0.0
    for path in np.ndindex(*(3,) * len(sequence)):
        p = start[path[0]] * emit[sequence[0], path[0]]
        for t in range(1, len(sequence)):
            p *= step[path[t - 1], path[t]] * emit[sequence[t], path[t]]
        total += p
    model = hmm.Model.__new__(hmm.Model)
    model.exact = [start, step, emit]
    got = hmm.forward(model, np.zeros(len(sequence), np.int64), np.array(sequence), 1)
    assert got[0] == pytest.approx(math.log10(total))
    seg = np.full((1, 8), -1, np.int32)
    seg[0, : len(sequence)] = sequence
    like, first, moves, counts = hmm.expected(start.astype(np.float32), step.astype(np.float32), emit.astype(np.float32), seg, np.array([True]))
    assert like == pytest.approx(math.log10(total), rel=1e-5)
    assert first.sum() == pytest.approx(1, rel=1e-4) and moves.sum() == pytest.approx(len(sequence) - 1, rel=1e-4)
    assert counts.sum(1) == pytest.approx([1, 2, 1, 1], rel=1e-4)


def test_hmm_scores_against_a_plain_recursion(spark, corpus):
    """Every score is that of a forward recursion in plain Python, a token at a time, in logarithms, over the fitted parameters."""
    rows = list(corpus[:40]) + [(900, "unseen words only: qqq zzz"), (901, ""), (902, None), (903, "One ONE one")]
    docs = documents(spark, rows).select("doc_id", "text")
    model = hmm.fit(docs)[0].open()
    start, step, emit = (np.log(x) for x in model.exact)
    counts = Counter(x for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for x in re.findall(r"[^ \t-\r]+", (t or "").translate(ASCII_LOWER)))
    own = {int(h): k for k, h in enumerate(model.head_h[: model.own])}

    def plain(text):
        alpha, extra = None, 0.0
        for word in [*re.findall(r"[^ \t-\r]+", (text or "").translate(ASCII_LOWER)), None]:
            _, h, kind = hmm.tokens_of(*K.utf8(pa.array([word or ""])))
            symbol = own.get(int(h[0 if word else -1]))
            if symbol is None:
                k = int(kind[0])
                symbol = hmm.MODEL_WORDS + k
                extra += math.log10((counts[word] + 1) / (model.kinds_n[k] + model.kinds_v[k] + 1))
            alpha = start if alpha is None else np.array([np.logaddexp.reduce(alpha + step[:, s]) for s in range(hmm.STATES)])
            alpha = alpha + emit[symbol]
        return np.logaddexp.reduce(alpha) / math.log(10) + extra

    got = {r["doc_id"]: r["score"] for r in hmm.score(docs).collect()}
    assert got == pytest.approx({i: plain(t) for i, t in rows}, rel=1e-4)


def test_hmm_trains_on_all_texts(spark):
    """The model does not depend on the order of rows, and equals Baum-Welch in one piece on every text."""
    rng = random.Random(6)
    rows = [(i, text_of(rng, [f"{'ab'[i % 2]}{k}" for k in range(30)], 300)) for i in range(40)]
    models = [hmm.fit(documents(spark, r).select("doc_id", "text").coalesce(1))[0] for r in (rows, rows[::2] + rows[1::2])]
    assert np.allclose(models[0].emit, models[1].emit, rtol=1e-3) and np.allclose(models[0].step, models[1].step, rtol=1e-3)
    passes, seen = hmm._pass, []
    try:
        hmm._pass = lambda symbols, model: seen.append(symbols.count()) or passes(symbols, model)
        hmm.fit(documents(spark, rows).select("doc_id", "text"))
    finally:
        hmm._pass = passes
    assert seen == [sum(zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows)] * 9


# 5: neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    x = np.concatenate([centres[rng.integers(0, 30, 900)] + 0.05 * rng.normal(size=(900, 16)), rng.normal(size=(900, 16))]).astype(np.float32)
    x[100:140] = x[100]  # a very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] + [1.0] * 15), (5150, [None] + [1.0] * 15), (5200, [float("inf")] + [1.0] * 15), (5250, []), (5300, [1.0, 2.0]), (5350, [2.0, 4.5]), (0, rows[0][1]), (None, rows[1][1])]
    vectors = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, node string")
    got = ann.neighbours(vectors, vectors.where("vec_id % 50 = 0"), shard_size=700).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == {i for i in range(0, 1800, 50)} | {5300, 5350}
    assert sorted(by[5300]) == [(1, 5350, pytest.approx(11 / math.sqrt(5 * 24.25)))]
    assert [v for _, v, _ in sorted(by[100])] == [101, 102, 103, 104, 105]
    d = x.astype(np.float64)
    norm = np.sqrt((d * d).sum(1))
    hit = total = 0
    for q, found in by.items():
        if q >= 1800:
            continue
        s = d @ d[q] / (norm * norm[q])
        s[q] = -9
        want = np.lexsort((np.arange(1800), -s))[:5]
        hit, total = hit + len(set(want) & {v for _, v, _ in found}), total + 5
        for _, v, score in found:
            assert score == pytest.approx(s[v], abs=1e-12)
    assert hit >= 0.9 * total
    assert ann.neighbours(vectors.limit(0), vectors.limit(0)).count() == 0


def test_cosines_of_extreme_components(spark):
    rows = [(0, [1e200, 1.0]), (1, [1.0, 1.0]), (2, [1e-200, 1e-200]), (3, [-1e300, 1e300]), (4, [5e-324, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in ann.neighbours(vectors, vectors).collect()}
    h = math.sqrt(0.5)
    want = {(0, 1): h, (0, 2): h, (0, 3): -h, (0, 4): 1.0, (1, 2): 1.0, (1, 3): 0.0, (1, 4): h, (2, 3): 0.0, (2, 4): h, (3, 4): -h}
    assert got == pytest.approx(want | {(b, a): s for (a, b), s in want.items()}, abs=1e-12)


def test_numbers_that_place_one_each(spark):
    for n in (1, 7, 64):
        frame = spark.createDataFrame([(x,) for x in ann.one_each(spark, n)], "x int").repartition(n, "x")
        assert [r["n"] for r in frame.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()] == [1] * n


# 6: pages


def page(i, body):
    return (i, f"http://Host.example.org/{i}", f"<!DOCTYPE html><html><head><title>t{i}</title><script>var a='</p>';</script></head><body><div id='top-menu'><a>Home</a></div>{body}<footer>&copy; us</footer></body></html>")


@pytest.mark.parametrize("broadcast", [1 << 25, 0])
def test_wrapper_and_text(spark, monkeypatch, broadcast):
    monkeypatch.setattr(wrappers, "HELD_BYTES", broadcast)
    bodies = [f"<div class='post'><h2>Head {i}</h2><p>First &amp; {i}<br>line<p>Second&nbsp;  {i}</p>" + (f"<ul><li>a{i}<li>b{i}</ul>" if i % 2 else "") + f"<div class='share'>Share</div><span>Read more</span><div class='comments'><p>nice {i}</p></div></div>" for i in range(6)]
    rows = [page(i, b) for i, b in enumerate(bodies)] + [(90, None, None), (91, "", ""), (92, "http://x.org/1", "<article><header><h1>A</h1></header><p>B <b>c</p><aside>no</aside>"), (93, "http://x.org/2", "plain"), (0, rows_url := "http://Host.example.org/0", page(0, bodies[0])[2])]
    assert rows_url
    pages = spark.createDataFrame([r + ("x", 5) for r in rows], "page_id long, url string, html string, host string, text long")
    got = Counter((r["page_id"], r["text"]) for r in wrappers.main_text(pages, ["page_id", "url", "host"]).collect())
    want = Counter({(90, ""): 1, (91, ""): 1, (92, "A\n\nB c"): 1, (93, "plain"): 1})
    for i, *_ in rows[:6]:
        want[(i, f"Head {i}\n\nFirst & {i} line\n\nSecond {i}" + (f"\n\na{i}\n\nb{i}" if i % 2 else ""))] += 1 + (i == 0)
    assert got == want
    tree = wrappers.infer([r[2] for r in rows[:6]])
    said = wrappers.expression(tree)
    assert "(<p> #PCDATA <br> #PCDATA </p>)" not in said and "<h2> #PCDATA </h2>" in said
    assert "(<ul> (<li> #PCDATA </li>)+ </ul>)?" in said and "Read more" in said
    assert wrappers.main_text(pages.limit(0)).count() == 0


def test_what_is_left_out():
    body = "<header>h</header><nav>n</nav><div class='cookie-notice'>c</div><main><article><h1>T</h1><p>One</p><ins class=adsbygoogle>ad</ins><form><p>f</p></form><aside>s</aside><p style='display: none'>x</p><p>Two <script>1</script><b>bold</b></p><section id=comments><article class='comment'><p>nice</p></article></section></article><article class='comment'>c</article></main><div class='site-header'>h</div><footer>f</footer>"
    html = f"<html><body>{body}</body></html>"
    assert wrappers.extract(html, None, frozenset()) == "T\n\nOne\n\nTwo bold"
    assert wrappers.extract(html, *wrappers.decide(wrappers.infer([html, html.replace("One", "Uno")]))) == "T\n\nOne\n\nTwo bold"
    plain = "<div id='sidebar'>s</div><div class='body'><p>a</p><p>b</p></div>"
    assert wrappers.extract(plain, *wrappers.decide(wrappers.infer([plain]))) == "a\n\nb"


def test_copies_have_no_template(spark):
    """Copies of one article, whole or but for their title, lose nothing; a text that different articles share goes."""
    copy = "<html><body><article><h1>One head</h1><p>First of it.</p><p>Second of it.</p></article></body></html>"
    lone = "<html><head><title>t{i}</title></head><body><h2>Other {i}</h2><article><p>The lone paragraph.</p></article></body></html>"
    dated = "<html><body><article><h1>A head of copies</h1><span>Day {i}</span><p>The same long paragraph of all copies.</p></article></body></html>"
    other = "<html><body><article><h1>Head {i}</h1><p>Some words of article {i}.</p><span>Read more</span></article></body></html>"
    rows = [(100 * k + i, f"http://h{k}.org/{i}", x.replace("{i}", str(i))) for k, x in enumerate((copy, lone, dated, other)) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    for i in range(6):
        assert got[i] == "One head\n\nFirst of it.\n\nSecond of it."
        assert got[100 + i] == "The lone paragraph."
        assert got[200 + i] == f"A head of copies\n\nDay {i}\n\nThe same long paragraph of all copies."
        assert got[300 + i] == f"Head {i}\n\nSome words of article {i}."


def test_wrappers_decide(spark):
    """Pages without article elements and with boilerplate of unknown names come out right by their host's wrapper, and not without it."""
    rng = random.Random(8)
    words = lambda n: " ".join(rng.choice("tree stone river cloud grass field night storm".split()) for _ in range(n))
    rows, want, bare = [], {}, 0
    for i in range(40):
        title, parts, extra = words(4), [words(rng.randint(8, 40)) for _ in range(rng.randint(1, 5))], words(6)
        links = "".join(f"<a href=x>{words(2)}</a> " for _ in range(4))
        html = f"""<html><body><div class=q1><span>Our site</span>{links}</div><div class=k{i}><div class=z><h1>{title}</h1><div class=b><div class=v9><p>Written by the desk</p><p>All our stories are free</p></div>
{"".join(f"<p>{p}</p>" for p in parts)}<div class=w><i>Tell a friend</i></div></div></div></div><div class=t7>{extra}</div></body></html>"""
        rows.append((i, f"http://host.org/{i}", html))
        want[i] = "\n\n".join([title, *parts])
        bare += wrappers.extract(html, None, frozenset()) == want[i]
    assert bare == 0
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), ["page_id"]).collect()}
    assert got == want


def test_deep_pages_and_odd_tags(spark):
    deep = "<div>" * 10000 + "<p>at the bottom</p>" + "</div>" * 10000
    spans = "<article>" + "<b>" * 10000 + "bold" + "<p>x</p>" * 50
    odd = "<article><p class=o'x>It's here</p><p>that's <label>all</label></p><section class='notice-of-meeting'>N</section><div class='share-prices'>S</div><div class='share-buttons'>x</div><div id=post-comments>c</div></article>"
    rows = [(1, "http://a.org/1", deep), (2, "http://a.org/2", deep.replace("bottom", "end")), (3, "http://b.org/", spans), (4, "http://c.org/", odd)]
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    assert got == {1: "at the bottom", 2: "at the end", 3: "\n\n".join(["bold", *["x"] * 50]), 4: "It's here\n\nthat's all\n\nN\n\nS"}


@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
@settings(max_examples=200, deadline=None)
def test_alignment_is_a_longest_common_subsequence(x, y):
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            best[i + 1][j + 1] = best[i][j] + 1 if a == b else max(best[i][j + 1], best[i + 1][j])
    pairs = wrappers.aligned(x, y)
    assert len(pairs) == best[-1][-1] and all(x[i] == y[j] for i, j in pairs)
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:], strict=False))


def test_large_wrappers_forget_nothing(spark):
    """Elements of one page alone decide where the article is, however many there are."""
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    rows = []
    for i in range(2):
        own = "".join(f"<i class=x{name(6000 * i + j)}>w</i>" for j in range(6000))
        rows.append((i, f"http://wide.org/{i}", f"<html><body><div class=q><p>Same words</p></div><div class=k>{own}</div></body></html>"))
    found = wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), ["page_id"])
    assert {r["page_id"]: r["text"] for r in found.collect()} == {0: "w" * 6000, 1: "w" * 6000}


def test_wrappers_are_written_and_read():
    tree = wrappers.infer(["<p>a<i>b</i></p><p>c</p>", "<p>a</p><div>x</div>"])
    assert wrappers.loaded(wrappers.dumped(tree)) == tree


@given(st.text("<>/abp \"'=!-&;", max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_markup_is_read(text):
    depth = 0
    for e in wrappers.events(text):
        depth += (e[0] == "open") - (e[0] == "close")
        assert depth >= 0
    assert depth == 0
    wrappers.extract(text, None, frozenset())


# 7: n-gram join


def shingle_sets(rows, k):
    out = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^ \t-\r]+", (t or "").translate(ASCII_LOWER))
        out[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    return out


def brute_components(sets, percent):
    ids = sorted(sets)
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_ngram_join(spark, corpus, k, percent):
    rows = list(corpus) + [(i + 1000 if i is not None else None, t) for i, t, *_ in AWKWARD]
    got = ngram_join.ngram_components(documents(spark, rows, clash=True), k, percent).collect()
    assert len(got) == len(rows)
    sets = shingle_sets([r for r in rows if r[0] is not None], k)
    want = brute_components(sets, percent)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == {(i, len(sets[i]), want[i]) for i in sets}
    kept = ngram_join.one_of_each(documents(spark, rows, clash=True), k, percent)
    assert len(kept.columns) == 16
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({i: 1 for i in sets if want[i] == i}) + Counter({None: 2})


def test_ngram_join_beyond_one_block(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL_BLOCK", 4)
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(documents(spark, rows), 3, 90).collect()}
    assert got == brute_components(shingle_sets(rows, 3), 90)
    assert ngram_join.ngram_components(documents(spark, [])).count() == 0


# 8: languages


def language_rows():
    rng = random.Random(6)
    stems = {"aa": "the and of ing tion er".split(), "bb": "der und keit sch ung en".split(), "cc": "que les eau ment aux re".split()}
    return [(i, " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(2, 40))), lang) for i, lang in enumerate(rng.choices(sorted(stems), k=300))]


def test_language_id(spark):
    rows = language_rows() + [(i + 1000 if i is not None else None, t, None) for i, t, *_ in AWKWARD] + [(5000, "12345 --- !!", "aa"), (5001, "x" * 5000, "aa")]
    docs = documents(spark, rows, clash=True)
    model = langid.fit(docs)
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows)
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    held = [(r["lang"], r["lang_pred"]) for r in got if r["doc_id"] is not None and r["doc_id"] < 300 and out(r["doc_id"])]
    assert len(held) > 30 and sum(a == b for a, b in held) >= 0.95 * len(held)
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert und == {1001, 1002, 1003, 5000, None} and all(0 <= r["score"] <= 1 for r in got)
    kept = langid.with_language(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 5
    nothing = documents(spark, [(1, "text", None)])
    assert [tuple(r) for r in langid.identify(nothing, langid.fit(nothing), ["doc_id"]).collect()] == [(1, "und", 0.0)]


def test_forward_sums_all_segmentations():
    data = langid.piece_model.load()
    vocabulary = langid.Vocabulary(data)
    rng = np.random.default_rng(1)
    prob = np.concatenate([rng.random((vocabulary.size, 2)), np.zeros((1, 2))])
    floor = np.array([1e-3, 2e-3])
    word = "▁there"
    code = np.frombuffer(word.encode("utf-32-le"), np.uint32)
    prefix = langid.code_hash(code)
    got = langid.log_likelihoods(vocabulary, prob, floor, prefix, np.array([0]), np.array([len(word)]))[0]

    def total(at, lang):
        if at == len(word):
            return 1.0
        s = 0.0
        for n in range(1, min(vocabulary.longest, len(word) - at) + 1):
            piece = vocabulary.index.find(langid.K.span_hash(prefix, np.array([at]), np.array([at + n])))[0]
            p = prob[piece, lang] if piece >= 0 else floor[lang] if n == 1 else 0.0
            s += p * total(at + n, lang) if p else 0.0
        return s

    assert got == pytest.approx([math.log(total(0, 0)), math.log(total(0, 1))])


# 9: decontamination


def brute_hits(text, items, window):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOWER))
    w, hit, names = words(text), set(), set()
    for name, item in items:
        v = words(item)
        n = min(window, len(v))
        for k in range(len(v) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[k : k + n]:
                    hit |= set(range(p, p + n))
                    names |= {str(name)} - {"None"}
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("block_words", [1 << 19, 40])
def test_decontamination(spark, corpus, block_words):
    rng = random.Random(2)
    texts = [t for _, t in corpus if len(t.split()) > 40]
    items = [(i, " ".join(rng.choice(texts).upper().split()[5 : 5 + rng.randint(3, 30)])) for i in range(12)]
    items += [(50, "one"), (51, ""), (52, None), (None, " ".join(texts[0].split()[:15])), (3, items[3][1]), (53, "é🙂-x")]
    rows = list(corpus[:60]) + AWKWARD[:5] + AWKWARD[7:10] + [(900, "x é x one"), (901, " ".join(texts[1].split()[:20]) + " | " + " ".join(texts[2].split()[:20]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, rows, clash=True)
    got = decontaminate.contamination(docs, benchmark, keep=["doc_id", "text"], block_words=block_words).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == Counter((i, *(x if n < 2 else tuple(x) for n, x in enumerate(brute_hits(t, items, 13)))) for i, t, *_ in rows)
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, t, *_ in rows if not brute_hits(t, items, 13)[1])
    assert decontaminate.contamination(docs, benchmark.limit(0), keep=["doc_id"]).where("n_hit > 0").count() == 0
    assert decontaminate.clean(documents(spark, []), benchmark).count() == 0


def test_longest_matches(spark):
    words = [f"w{i}" for i in range(60)]
    benchmark = spark.createDataFrame([(1, " ".join(words[:40]))], "item_id long, text string")
    docs = documents(spark, [(1, "x y " + " ".join(words[3:33]) + " z"), (2, " ".join(words[:12])), (3, " ".join(words[10:60]))])
    got = {r["doc_id"]: (r["n_hit"], r["longest"], r["longest_at"]) for r in decontaminate.contamination(docs, benchmark).collect()}
    assert got == {1: (30, 30, 2), 2: (0, 0, -1), 3: (30, 30, 0)}


# 10: pieces


def test_pieces_match_the_reference_library(spark):
    import sentencepiece

    data = pieces.P.load()
    reference = sentencepiece.SentencePieceProcessor(model_proto=data)
    codec = pieces.Codec(data)
    texts = ["", " ", "  a  b ", "\n\tx", "日本語 テキスト", "🙂👍🏽 é", "▁▁ x ▁", "a\x00b", "<s> </s> <0x41>", "x" * 2000, LONG[:5000], "Hello, world!\n\nBye."]
    got, want = codec.encode(texts), reference.encode(texts)
    assert got == want
    assert [codec.decode(x) for x in got] == reference.decode(want)
    docs = documents(spark, [(i, t) for i, t in enumerate(texts)] + AWKWARD, clash=True)
    coded = pieces.encode(docs)
    assert {r["doc_id"]: r["ids"] for r in coded.where("doc_id >= 9").collect()} == {i: want[i] for i in range(9, len(texts))}
    back = pieces.decode(coded.select("doc_id", "ids"), keep=["doc_id"]).collect()
    # The marker itself is text that decodes to a space: no other text is changed.
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((i, None if t is None else t.replace("▁", " ")) for i, t, *_ in [*enumerate(texts), *AWKWARD])
    told = pieces.digests(docs, keep=["doc_id"]).where("doc_id = 11").first()
    assert told["ids_sha256"] == hashlib.sha256(np.array(want[11], "<i4").tobytes()).hexdigest() and told["round_trip"]
    assert pieces.digests(documents(spark, [])).count() == 0
    assert Counter(r["same"] for r in pieces.parity(docs).collect()) == Counter({True: len(texts) + 9, None: 2})


def test_unigram_files_become_unigram_models():
    def field(number, kind, body):
        return bytes([number << 3 | kind]) + (bytes([len(body)]) + body if kind == 2 else body)

    import struct

    def piece(text, score, kind=1):
        return field(1, 2, field(1, 2, text.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind])))

    data = piece("<unk>", 0, 2) + b"".join(piece(p, s) for p, s in (("▁", -2.0), ("▁ab", -1.0), ("a", -3.0), ("b", -3.5), ("c", -2.5), ("bc", -2.6))) + field(2, 2, field(3, 0, b"\x01"))
    codec = pieces.Codec(data)
    assert [codec.model.pieces[i][0] for i in codec.encode(["abc"])[0]] == ["▁ab", "c"]
    assert codec.decode(codec.encode(["abc b"])[0]) == "abc b"
