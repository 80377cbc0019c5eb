"""Suffix, exact, near and line deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from recquarry.llm import exact_dedup, line_dedup, minhash_dedup, suffix_dedup

ROWS = "doc_id long, text string, n_bytes string"


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], ROWS)


def words(rnd, n, letters="abcdefgh"):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(2, 7))) for _ in range(n))


# suffix arrays


def covered(texts):
    """(n_bytes, n_removed, n_spans, kept digest) of every text by counting all windows."""
    data = [(t or "").encode() for t in texts]
    width = suffix_dedup.LENGTH
    seen = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        flags = bytearray(len(d))
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                flags[i : i + width] = b"\1" * width
        kept = bytes(c for c, f in zip(d, flags) if not f)
        out.append((len(d), sum(flags), len(re.findall(b"\1+", bytes(flags))), hashlib.sha256(kept).hexdigest()))
    return out


def repeated_texts():
    rnd = random.Random(7)
    base = [words(rnd, 120), words(rnd, 80, "ab"), "é" * 150 + words(rnd, 60, "éßñ"), "\0\1" * 130 + words(rnd, 50)]
    texts = [*base, None, "", "short", "a" * 500, "ab" * 220, base[0], base[0].upper()]
    for _ in range(25):
        b = rnd.choice(base)
        i = rnd.randrange(len(b))
        texts.append(words(rnd, rnd.randrange(0, 9)) + b[i : i + rnd.randrange(150, 400)] + words(rnd, rnd.randrange(0, 9)))
    texts.append(words(rnd, 30000))  # a very long text, and a passage of it elsewhere
    texts.append(texts[-1][50000:50400])
    return texts


@pytest.mark.parametrize("hot", [None, 1])
def test_repeated_bytes(spark, hot):
    texts = repeated_texts()
    got = suffix_dedup.remove_repeats(frame(spark, texts), hot=hot).collect()
    assert len(got) == len(texts)
    for r, want in zip(sorted(got, key=lambda r: r.doc_id), covered(texts)):
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want
        assert sum(s.high - s.low for s in r.spans) == r.n_removed


def test_repeated_bytes_in_small_batches(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH_WINDOWS", 50)
    rnd = random.Random(1)
    base = words(rnd, 90).encode()
    segments = [base[i : i + 260] for i in range(0, 200, 13)] + [base[:260]]
    windows = np.array([len(s) - suffix_dedup.LENGTH + 1 for s in segments])
    every = np.full(len(segments), 10**6)
    got = suffix_dedup.repeated_windows(segments, windows, np.zeros(len(segments), int), every)
    seen = Counter(s[i : i + suffix_dedup.LENGTH] for s, w in zip(segments, windows) for i in range(w))
    for s, w, g in zip(segments, windows, got):
        assert g.tolist() == [i for i in range(w) if seen[s[i : i + suffix_dedup.LENGTH]] > 1]


def test_suffixes_repeated_rows_and_no_rows(spark):
    text = words(random.Random(3), 60)
    twice = suffix_dedup.remove_repeats(frame(spark, [text, text, "z"], [5, 5, None])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in twice) == [(0, 0), (5, len(text)), (5, len(text))]
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


# exact copies


def lower_ascii(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("runs", [2, 70])
def test_exact_copies(spark, keep, runs, monkeypatch):
    rnd = random.Random(4)
    pool = ["", None, "Ä b", "ä b", "ABC", "abc", "x" * 70000] + [words(rnd, 3) for _ in range(20)]
    texts = [rnd.choice(pool) for _ in range(300)] + ["hot"] * 200
    df = frame(spark, texts).repartition(9)
    spark.conf.set("spark.sql.shuffle.partitions", str(runs))
    try:
        got = {r.doc_id: r for r in exact_dedup.find_copies(df, keep=keep).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[lower_ascii(t)].append(i)
    assert len(got) == len(texts)
    for text, ids in groups.items():
        stays = max(ids) if keep == "largest" else min(ids)
        for i in ids:
            digest = hashlib.sha256(text.encode()).hexdigest()
            assert tuple(got[i])[1:] == (stays, len(ids), i == stays, digest)


def test_exact_odd_rows(spark):
    df = frame(spark, ["a", "A", "a", "b", "b"], [1, None, 1, 2, 2])
    kept = exact_dedup.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a"), (2, "b")]
    lone = exact_dedup.find_copies(frame(spark, ["a"], [None])).first()
    assert lone.doc_id is None and lone.keep_id is None and lone.kept
    assert exact_dedup.find_copies(frame(spark, [])).count() == 0
    assert exact_dedup.deduplicate(frame(spark, [])).count() == 0


# near copies


def jaccard_classes(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and common / (len(sets[a]) + len(sets[b]) - common) >= 0.8:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]


def edited(rnd, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rnd.randrange(len(w))] = words(rnd, 1)
    return " ".join(w)


def near_texts():
    rnd = random.Random(11)
    texts = [None, "", "one two", "one two", "One, two!", "!!!", "a " * 40, "a " * 45]
    for n in (40, 120, 300):
        base = words(rnd, n)
        texts.append(base)
        texts += [edited(rnd, base, rnd.choice([1, 2, n // 60 + 1, n // 20, n // 5])) for _ in range(25)]
        texts.append(base.upper())
    chain = words(rnd, 200)
    for _ in range(8):  # neighbours are alike, the ends are not
        chain = edited(rnd, chain, 3)
        texts.append(chain)
    return texts + [words(rnd, rnd.randrange(1, 80)) for _ in range(60)]


@pytest.mark.parametrize("small", [16, 2])
def test_near_copies(spark, small, monkeypatch):
    """With tiny buckets the hubs and the deeper bands do the work."""
    monkeypatch.setattr(minhash_dedup, "SMALL", small)
    texts = near_texts()
    df = frame(spark, texts)
    got = {r.doc_id: r.class_id for r in minhash_dedup.classes(df).collect()}
    assert [got[i] for i in range(len(texts))] == jaccard_classes(texts)
    if small == 16:
        kept = minhash_dedup.deduplicate(df)
        assert kept.columns == df.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(set(jaccard_classes(texts)))


def test_near_copies_in_a_crowd(spark, monkeypatch):
    """Pairs inside a family of documents that share most of their text, but lie below 0.8 to its hub."""
    monkeypatch.setattr(minhash_dedup, "SMALL", 2)
    rnd = random.Random(5)
    core, texts = words(rnd, 300), []
    for _ in range(150):
        own = words(rnd, 50)
        texts += [core + " " + own, edited(rnd, core, 7) + " " + own]
    found = jaccard_classes(texts)
    assert 100 < len(set(found)) < 250
    got = {r.doc_id: r.class_id for r in minhash_dedup.classes(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == found


def test_near_odd_rows(spark):
    got = minhash_dedup.classes(frame(spark, ["a b c d e f", "a b c d e f", "a b c d e f", ""], [3, 3, None, 9])).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0) for r in got) == [(0, 0), (3, 3), (3, 3), (9, 9)]
    assert minhash_dedup.classes(frame(spark, [])).count() == 0


def test_registers_estimate_the_similarity():
    rnd = random.Random(2)
    base = words(rnd, 2000)
    texts = [base, edited(rnd, base, 60)]
    owner, value, count = minhash_dedup.shingles(texts)
    registers = minhash_dedup.prob_min_hash(owner, value, count, 2)
    sets = [set(value[owner == k].tolist()) for k in (0, 1)]
    true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert abs((registers[0] == registers[1]).mean() - true) < 0.15


def test_repeated_passages_do_not_move_the_registers(spark):
    """Half of one text is pasted hundreds of times; the sets of both stay alike."""
    rnd = random.Random(21)
    texts = []
    for times in (30, 300):
        for _ in range(20):
            base = words(rnd, 500)
            half = " ".join(base.split(" ")[:250])
            texts += [base, " ".join([edited(rnd, base, 8)] + [half] * times)]
    rows = {r.id: r for r in minhash_dedup.signatures(frame(spark, texts)).collect()}
    for i in range(0, len(texts), 2):
        owner, value, _ = minhash_dedup.shingles(texts[i : i + 2])
        sets = [set(value[owner == k].tolist()) for k in (0, 1)]
        true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        same = np.mean([x == y for x, y in zip(rows[i].marks, rows[i + 1].marks)])
        assert true > 0.8 and abs(same - true) < 5 * (true * (1 - true) / minhash_dedup.REGISTERS) ** 0.5


# lines


def kept_lines(texts):
    first, lines = {}, [(t or "").split("\n") for t in texts]
    for d, ls in enumerate(lines):
        for i in range(len(ls) - 2):
            first.setdefault(tuple(ls[i : i + 3]), (d, i))
    out = []
    for d, ls in enumerate(lines):
        gone = set()
        for i in range(len(ls) - 2):
            w = tuple(ls[i : i + 3])
            d0, i0 = first[w]
            if "".join(w).strip() and (d0, i0) != (d, i):
                gone |= set(range(i, i + 3)) - (set(range(i0, i0 + 3)) if d0 == d else set())
        out.append((len(ls), len(gone), "\n".join(x for i, x in enumerate(ls) if i not in gone)))
    return out


def test_lines(spark):
    rnd = random.Random(8)
    pool = ["", " ", "a", "b", "c", "d", "é"]
    texts = [None, "", "a\na\na\na\na", "\n\n\n\n", "x\n" * 3000] + [
        "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 12))) for _ in range(120)
    ]
    got = sorted(line_dedup.remove_repeats(frame(spark, texts)).collect(), key=lambda r: r.doc_id)
    assert [(r.n_lines, r.n_removed, r.text) for r in got] == kept_lines(texts)
    assert all(len(r.removed) == r.n_removed for r in got)


def test_lines_odd_rows(spark):
    df = frame(spark, ["a\nb\nc", "a\nb\nc", "a\nb\nc"], [4, 4, None])
    got = sorted((r.doc_id or 0, r.n_removed) for r in line_dedup.remove_repeats(df).collect())
    assert got == [(0, 0), (4, 3), (4, 3)]  # null ids come first
    assert line_dedup.remove_repeats(frame(spark, [])).count() == 0
