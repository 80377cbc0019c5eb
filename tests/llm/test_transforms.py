"""Fill-in-the-middle, spelling variants and forced-boundary BPE against brute force and the library."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("public_tokenizers")

import public_tokenizers  # noqa: E402
from recquarry.llm import fill_in_middle as fim  # noqa: E402
from recquarry.llm import forced_bpe, spelling  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string"
LONG = "Ab c, é中\n" * 60_000


# fill-in-the-middle ------------------------------------------------------------


def cut_by_hand(i, text):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", "a", "é", "<P>", "x<M>y", "<", "<S", "ab cd", "中文 letters ü", "A" * 17, "\n\n", "a" * 7 + "é" + "b" * 8, "z{`@[", LONG]


def test_cuts_of_texts_of_all_kinds(spark):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(40 * len(TEXTS)) if i % len(TEXTS) != len(TEXTS) - 1 or i < 60]
    made = fim.transform(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    texts = dict(rows)
    assert len(made) == len(rows)
    for r in made:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == cut_by_hand(r.doc_id, texts[r.doc_id] or "")
        assert r.restored == (texts[r.doc_id] or "")
    assert {r.form for r in made} == {"plain", "psm", "spm"}


@given(st.lists(st.text(st.sampled_from("abZ<P>SM é中😀\n{@"), max_size=25), min_size=1, max_size=12), st.integers(0, 10**6))
@settings(max_examples=200, deadline=None)
def test_words_of_bytes_find_the_same_cuts(texts, first):
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    digests = [hashlib.sha256(f"1:{first + i}".encode()).hexdigest() for i in range(len(texts))]
    draws = np.array([[int(d[8 * k : 8 * k + 8], 16) for k in range(4)] for d in digests])
    made = list(fim.arrange(np.frombuffer(b"".join(raw), np.uint8), offsets, draws, 90, 20))
    for i, (text, (n, form, head, mid, out)) in enumerate(zip(texts, made)):
        assert (n, form, head, mid, out.decode()) == cut_by_hand(first + i, text)
        assert fim.restore(out, form).decode() == text


def test_groups_cover_all_texts():
    offsets = np.array([0, 5, 5, 100, 101, 103, 103])
    ranges = list(fim.groups(offsets, 4))
    assert ranges[0][0] == 0 and ranges[-1][1] == 6 and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))


def test_clashing_columns_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "ab cd", 7, "kept", None)], DOCS + ", n long, row string, r int")
    out = fim.transform(df)
    assert out.columns == ["doc_id", "text", "row", "r", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    assert out.first()["row"] == "kept" and out.first()["n"] == 3
    nulls = fim.transform(spark.createDataFrame([(None, "ab cd"), (None, "ab cd")], DOCS)).collect()
    assert nulls[0] == nulls[1] and nulls[0].output == cut_by_hand("", "ab cd")[4]
    assert fim.transform(spark.createDataFrame([], DOCS)).count() == 0


# spelling variants ---------------------------------------------------------------


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(counts, ratio):
    found = {}
    for w in counts:
        around = [v for v in counts if near(w, v)]
        best = min(around, key=lambda v: (-counts[v], v), default=None)
        found[w] = (best if best and counts[best] >= ratio * counts[w] else None, len(around))
    rows = []
    for w, (form, n_near) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        rows.append((w, form, root, counts[w], n_near, counts.get(form)))
    return sorted(rows)


@given(st.dictionaries(st.text(st.sampled_from("abé"), min_size=1, max_size=9), st.integers(1, 400), max_size=60))
@settings(max_examples=4, deadline=None)
def test_variants_against_all_pairs(spark, counts):
    df = spark.createDataFrame(sorted(counts.items()), "word string, n long")
    assert sorted(map(tuple, spelling.variants(df, 3).collect())) == variants_by_hand(counts, 3)


def test_chains_are_followed_to_the_end(spark):
    words = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb", "abbbbb", "bbbbbb"]
    counts = {w: 2**k for k, w in enumerate(words)}
    made = {r.word: r for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), 2).collect()}
    assert all(r.root == "bbbbbb" for r in made.values()) and made["bbbbbb"].form is None


def test_every_single_edit_meets_in_some_key(spark):
    word = "abcdefghijk"
    edits = {word[:i] + "X" + word[i + 1 :] for i in range(11)} | {word[:i] + "X" + word[i:] for i in range(12)}
    edits |= {word[:i] + word[i + 1 :] for i in range(11)}
    df = spark.createDataFrame([(w, 1) for w in [word, *edits]], "word string, n long")
    pairs = spelling.near_pairs(df).collect()
    met = sorted(tuple(sorted((r.word, r.other))) for r in pairs)
    every = [word, *edits]
    assert met == sorted({tuple(sorted((a, b))) for a in every for b in every if near(a, b)})


def test_counts_and_slips(spark):
    texts = {1: "Éclair éclair ÉCLAIR eclair! word words", 2: None, 3: "", 4: "straße×÷straße wordsAndMore", None: "unknown unknown"}
    rows = [(i, t) for i, t in texts.items()] * 3
    df = spark.createDataFrame(rows, DOCS)
    expected, slipped = {}, {}
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            k = h % len(w)
            for out, v in ((expected, w), (slipped, w[:k] + w[k + 1 :] if h % 3 == 0 else w)):
                if len(v) >= 6:
                    out[v] = out.get(v, 0) + 1
    keep = lambda d: {w: n for w, n in d.items() if n >= 3}
    assert {r.word: r.n for r in spelling.count_words(df, min_count=3).collect()} == keep(expected)
    assert {r.word: r.n for r in spelling.count_words(df, min_count=3, slip_one_in=3).collect()} == keep(slipped)
    assert spelling.variants(spelling.count_words(df.where("doc_id = 2"))).count() == 0


def test_hot_word_and_very_long_text(spark):
    rows = [(i, "common common") for i in range(3000)] + [(9999, "commons " * 50_000)]
    made = {r.word: (r.form, r.n) for r in spelling.variants(spelling.count_words(spark.createDataFrame(rows, DOCS))).collect()}
    assert made == {"common": ("commons", 6000), "commons": (None, 50_000)}


# forced-boundary BPE -------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(PATH)


PIECES = ["'", "s", "'s", "t", "re", "ve", " ", "  ", "\n", "\t", "1", "23", "é", "中", "😀", "<|endoftext|>", "<|endo", "-", "--", "\x85", "\x1c", "　", "՘", "ab" * 40, "=" * 90, " " * 70]


@given(st.lists(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=3)), max_size=20).map("".join), max_size=15))
@settings(max_examples=150, deadline=None)
def test_ids_and_texts_as_the_library(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    made = list(forced_bpe.encode_batch(texts, PATH))
    assert made == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    for ids in made:
        assert forced_bpe.decode_ids(ids, PATH) == tok.decode(ids, skip_special_tokens=False)


def test_every_code_point(library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join("a" + c + "1" + c + "'" + c + " ." + c for c in points[i : i + 500]) for i in range(0, len(points), 500)]
    made = list(forced_bpe.encode_batch(texts, PATH))
    assert made == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_ids_that_are_no_text(library):
    for ids in ([128, 50256, 255], [187], []):
        assert forced_bpe.decode_ids(ids, PATH) == library.decode(ids, skip_special_tokens=False)


def test_no_token_spans_a_forced_boundary():
    vocabulary = forced_bpe.read_vocabulary(PATH)
    for token in vocabulary.by_id:
        data = np.frombuffer(token, np.uint8)
        if len(data) and token != b"<|endoftext|>":
            assert forced_bpe.boundaries(data, vocabulary.inside).sum() == 1


def test_both_ways_of_merging_agree():
    vocabulary = forced_bpe.read_vocabulary(PATH)
    for text in ("aaaaaaaaaaa", "international", "abababab", "=====-----", "ééé中中"):
        raw = text.encode()
        assert forced_bpe.merge(raw, vocabulary) == forced_bpe._merge_long([vocabulary.byte_ids[b] for b in raw], vocabulary.merges)


def test_columns_nulls_and_long_texts(spark, library):
    texts = [None, "", "plain text", LONG, "x" * 300_000, "plain text"]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3)
    out = df.select("doc_id", forced_bpe.encode("text", PATH).alias("ids")).withColumn("back", forced_bpe.decode("ids", PATH))
    made = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(texts):
        assert list(made[i].ids) == library.encode(t or "", add_special_tokens=False).ids and made[i].back == (t or "")
    digest = {r.doc_id: r.r for r in df.select("doc_id", forced_bpe.digests("text", PATH).alias("r")).collect()}
    for i, t in enumerate(texts):
        packed = np.array(made[i].ids, "<u4").tobytes()
        assert digest[i] == (len(made[i].ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert df.where("false").select(forced_bpe.digests("text", PATH)).count() == 0


def test_other_files_are_refused(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["ignore_merges"] = True
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        forced_bpe.read_vocabulary(str(other))
