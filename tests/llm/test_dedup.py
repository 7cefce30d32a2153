"""Passages, lines and similar sets against brute force."""

import hashlib
import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wardline.llm import jaccard, lines, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeats(rows, k):
    seen, out = {}, {}
    for i, text in sorted((i, t or "") for i, t in rows):
        words = WORD.findall(text)
        gone = [False] * len(words)
        for s in range(len(words) - k + 1):
            window = tuple(words[s : s + k])
            if seen.setdefault(window, (i, s)) != (i, s):
                gone[s : s + k] = [True] * k
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("k", [20, 7])
def test_repeated_passages(docs, texts, k):
    rows = substring.drop_repeats(docs, k).collect()
    want = repeats(enumerate(texts), k)
    assert len(rows) == docs.count()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == want


def test_repeats_with_branches_and_null_ids(spark):
    a, b, c = ([f"{x}{i}" for i in range(30)] for x in "abc")
    rows = [(None, a + b), (1, b + c), (2, a + b + c), (3, c + a), (4, b[:25] + c[5:]), (5, a[:10] + b + a), (6, (a[:3]) * 30)]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.drop_repeats(frame).collect()}
    want = repeats([(-1 if i is None else i, " ".join(w)) for i, w in rows], 20)
    want[None] = want.pop(-1)
    assert got == want


def test_repeats_of_texts_that_share_an_id(spark):
    a, b, c = ([f"{x}{i}" for i in range(30)] for x in "abc")
    rows = [(None, a + b), (None, c[:7] + a), (None, c[:3]), (None, c[:3]), (3, b + c), (3, b), (3, c[4:]), (3, a[:9] + b[2:]), (4, c), (4, c), (5, a), (None, None)]
    frame = spark.createDataFrame([(i, w and " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(4)
    digest = {r.text: r.h for r in frame.selectExpr("text", "xxhash64(text) as h").collect()}
    rows = [(i, w and " ".join(w)) for i, w in rows]
    named = sorted({(-1 if i is None else i, digest[t], t or "") for i, t in rows})
    want = repeats([((i, d), t) for i, d, t in named], 20)
    want = sorted((i, *want[i, d]) for i, d in ((-1 if i is None else i, digest[t]) for i, t in rows))
    got = substring.drop_repeats(frame).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want


def test_empty_tables(none):
    assert substring.drop_repeats(none).collect() == []
    assert jaccard.group_similar(none).collect() == []
    assert lines.drop_near_lines(none).collect() == []


def shingles(text, k):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(words)
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def components(sets, num, den):
    root = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {i: new if r == old else r for i, r in root.items()}
    return root


@pytest.mark.parametrize("words,num,den", [(4, 85, 100), (5, 80, 100), (1, 50, 100)])
def test_similar_sets(docs, texts, words, num, den):
    rows = jaccard.group_similar(docs, words, num, den).collect()
    sets = {i: shingles(t, words) for i, t in enumerate(texts)}
    root = components(sets, num, den)
    assert len(rows) == docs.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {i: (len(sets[i]), root[i]) for i in sets}


def test_similar_sets_join_over_small_tries(docs, texts, monkeypatch):
    monkeypatch.setattr(jaccard, "CELL", 150)
    rows = jaccard.group_similar(docs, 4).collect()
    root = components({i: shingles(t, 4) for i, t in enumerate(texts)}, 85, 100)
    assert {r.doc_id: r.component_id for r in rows} == root


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), min_size=1, max_size=12), min_size=1, max_size=25, unique_by=frozenset), st.sampled_from([50, 80, 85]))
def test_trie_finds_what_all_pairs_find(sets, num):
    trie = jaccard.Trie([np.array(sorted(s), np.uint64) for s in sets])
    for i, a in enumerate(sets):
        want = [j for j, b in enumerate(sets) if 100 * len(a & b) >= num * len(a | b)]
        assert trie.query(i, num, 100).tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), min_size=1, max_size=12), min_size=1, max_size=25, unique_by=frozenset), st.sampled_from([50, 80, 85]))
def test_trie_of_beginnings_meets_all_similar_sets(sets, num):
    whole = [np.array(sorted(s), np.uint64) for s in sets]
    begin = [s[: jaccard.prefix_length(len(s), num, 100)] for s in whole]
    trie = jaccard.Trie(begin, np.array([len(s) for s in whole]))
    for i, a in enumerate(sets):
        want = {j for j, b in enumerate(sets) if 100 * len(a & b) >= num * len(a | b)}
        assert want <= set(trie.meet(i, num, 100).tolist())


def test_variants_of_a_text_meet_in_tries_dealt_over_blocks(spark, monkeypatch):
    for name, value in (("CELL", 150), ("FEW", 2), ("WIDE", 3)):
        monkeypatch.setattr(jaccard, name, value)
    draw = np.random.default_rng(5)
    rows = []
    for base in range(4):
        words = [f"w{base}x{k}" for k in range(60 + 20 * base)]
        for _ in range(25):
            mine = list(words[: int(draw.integers(len(words) * 8 // 10, len(words) + 1))])
            for at in draw.integers(0, len(mine), int(draw.integers(0, 4))):
                mine[at] = f"v{draw.integers(1000)}"
            rows.append((len(rows), " ".join(mine)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.group_similar(frame).collect()}
    sets = {i: shingles(t, 4) for i, t in rows}
    assert got == components(sets, 85, 100)
    assert 4 < len(set(got.values())) < 100


def test_sketch_puts_frequent_ngrams_last(spark):
    draw = np.random.default_rng(1)
    often = draw.integers(0, 1 << 63, 5).astype(np.uint64)
    rows = []
    for part in range(3):
        sketch = jaccard.Sketch()
        sets = [np.unique(np.concatenate([often, draw.integers(0, 1 << 63, 50).astype(np.uint64)])) for _ in range(20)]
        sketch.add(sets + sets, [(part, i) for i in range(20)] * 2)  # copies count once
        assert sketch.counts[int(often[0]) & (jaccard.COUNTERS - 1)] == 20
        rows += sketch.rows()
    level = jaccard.levels(spark.createDataFrame(rows, "chunk int, counts binary"))
    assert len(level) == jaccard.COUNTERS
    at = lambda x: level[(x & np.uint64(jaccard.COUNTERS - 1)).astype(int)]
    assert at(often).min() > np.median(at(np.setdiff1d(np.concatenate(sets), often)))


def near(a, b):
    """Edit distance of at most 1."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


@pytest.mark.parametrize("edits", [0, 1])
def test_lines(docs, texts, edits):
    rows = lines.drop_near_lines(docs, edits=edits, min_chars=5).collect()
    places = [(i, n, x) for i, t in enumerate(texts) if t is not None for n, x in enumerate(t.split("\n"))]
    want = {}
    for i, t in enumerate(texts):
        parts = [] if t is None else t.split("\n")
        gone = [
            len(x) >= 5 and any((j, m) < (i, n) and (x == y or edits and len(y) >= 5 and near(x, y)) for j, m, y in places)
            for n, x in enumerate(parts)
        ]
        left = None if t is None else "\n".join(x for x, g in zip(parts, gone) if not g)
        want[i] = (len(parts), sum(gone), left)
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in rows} == want
    assert set(docs.columns) <= set(rows[0].asDict()) and len(rows) == docs.count()


def test_lines_one_edit_apart_meet_whatever_the_edit(spark):
    base = "the quick brown fox jumps over it"
    variants = [base, *[base[:i] + "#" + base[i + 1 :] for i in (0, 16, 32)], *[base[:i] + base[i + 1 :] for i in (0, 17, 32)], *[base[:i] + "é" + base[i:] for i in (0, 16, 33)]]
    far = "THE quick brown fox jumps over it"
    frame = spark.createDataFrame([(i, v) for i, v in enumerate([*variants, far])], "doc_id long, text string")
    gone = {r.doc_id: r.n_removed for r in lines.drop_near_lines(frame).collect()}
    assert gone == {i: int(i > 0) for i in range(len(variants))} | {len(variants): 0}
