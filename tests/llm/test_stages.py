"""Stages and operators that keep the input's columns on odd rows, and windows of templates against a direct count."""

import os
import random

import pytest
import regex

from recquarry.llm import decontaminate, exact_dedup, minhash_dedup, url_filter

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# names that helper columns have or had somewhere
EXTRA = ["_id", "_d", "_k", "_tk", "_text", "_value", "_dropped", "id", "k", "d", "h", "lines", "run", "size", "row_id", "digest", "dropped", "hit_id", "KEY", "url_text"]


def with_extra(spark, rows, columns):
    data = [(*r, *(f"{c}{i}" for c in EXTRA)) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, ", ".join([columns, *(f"`{c}` string" for c in EXTRA)]))


def odd_documents(spark):
    rnd = random.Random(5)
    plain = [" ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randrange(2, 8))) for _ in range(60)) for _ in range(6)]
    long = " ".join("".join(rnd.choice("etaoinshr") for _ in range(5)) for _ in range(60_000))
    texts = [*plain, None, "", "", "!", long, plain[0], plain[1] + " x", plain[2].upper()]
    return with_extra(spark, [(i, t) for i, t in enumerate(texts)] + [(3, plain[3])], "doc_id long, text string"), texts


def untouched(out, docs):
    assert out.columns == docs.columns
    before = {tuple(r) for r in docs.collect()}
    rows = [tuple(r) for r in out.collect()]
    assert set(rows) <= before
    return rows


KEEPERS = {
    "exact": lambda d, b: exact_dedup.deduplicate(d),
    "near": lambda d, b: minhash_dedup.deduplicate(d),
    "decontaminate": lambda d, b: decontaminate.decontaminate(d, b),
}


@pytest.mark.parametrize("name", list(KEEPERS))
def test_extra_columns_and_odd_rows(spark, name):
    docs, texts = odd_documents(spark)
    bench = with_extra(spark, [(1, texts[4]), (2, None), (3, "")], "item_id long, text string")
    rows = untouched(KEEPERS[name](docs, bench), docs)
    ids = sorted(r[0] for r in rows)
    n = len(texts)
    if name == "exact":  # the largest id of equal texts; null is empty; one of the repeated rows
        assert ids == sorted(set(range(n)) - {0, 2, 6, 7})
    elif name == "near":  # one of each class; texts without shingles stay
        assert {3, 4, 5, 6, 7, 8, 9, 10} <= set(ids) and len({0, 11} & set(ids)) == len({1, 12} & set(ids)) == 1
    else:
        assert ids == sorted([*(set(range(n)) - {4}), 3])
    assert untouched(KEEPERS[name](docs.limit(0), bench), docs) == []
    assert len(untouched(KEEPERS[name](docs, bench.limit(0)), docs)) > 5


def test_pages_with_extra_columns(spark):
    urls = ["http://a.com/x", "http://b.net/es/y", None, "", "no host", "http://a.com/x", "http://c.org/" + "z" * 5000]
    pages = with_extra(spark, list(enumerate(urls)), "page_id long, url string")
    out = url_filter.judge(pages, [("allow", "com/"), ("block", "net/es/")])
    assert out.columns[: len(pages.columns)] == pages.columns
    assert {tuple(r) for r in out.select(*(f"`{c}`" for c in pages.columns)).collect()} == {tuple(r) for r in pages.collect()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_stages_on_odd_rows(spark):
    pytest.importorskip("public_tokenizers")
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs, texts = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = untouched(stage(spark, docs, SF), docs)
        assert len(rows) >= 8 and untouched(stage(spark, docs.limit(0), SF), docs) == [], name
    name, stage = corpus_pipeline.STAGES[-1]
    assert stage(spark, docs, SF).count() == len(texts) + 1 and stage(spark, docs.limit(0), SF).count() == 0


# windows of templates


def slow_marks(text):
    tokens = regex.findall(decontaminate.TOKEN, text)
    out = []
    for i, t in enumerate(tokens):
        before = tokens[i - 1] if i else None
        if t in ".!?\n":
            continue
        if regex.match(r"\p{N}", t):
            out.append(("n", t))
        elif t.lower() in decontaminate.UNITS and before and regex.match(r"\p{N}", before):
            out.append(("u", t.lower()))
        elif regex.match(r"\p{Lu}\p{Ll}", t):
            out.append(("either" if before is None or before in ".!?\n" else "p", t.lower()))
        else:
            out.append(("", t.lower()))
    return out


def slow_windows(text, width):
    """(pos, names, template, slots) of all readings."""
    marks = slow_marks(text)
    for pos in range(len(marks) - width + 1):
        part = marks[pos : pos + width]
        for names in range(1 << width):
            chosen = [j for j in range(width) if names >> j & 1]
            if len(chosen) > width - decontaminate.MIN_WORDS + 1 or any(part[j][0] != "either" for j in chosen):
                continue
            kinds = ["p" if j in chosen else "" if k == "either" else k for j, (k, _) in enumerate(part)]
            template = tuple((k, "" if k else v) for k, (_, v) in zip(kinds, part))
            slots = [(decontaminate.FIRST if j in chosen else "\u0001" + k) + v for j, (k, (_, v)) in enumerate(zip(kinds, part)) if k]
            yield pos, names, (width, template), slots


@pytest.mark.parametrize("piece", [decontaminate.PIECE, 3])
def test_windows_are_the_slow_ones(spark, monkeypatch, piece):
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    rnd = random.Random(8)
    words = ["we", "We", "Anna", "anna", "12", "1,5", "km", "km", "saw", "Saw", ".", "\n", "a!", "été", "Été", "٣", "ⅷ", "二", "x2", "ǅa"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 30))) for _ in range(60)] + ["", "...", "We"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    from pyspark.sql import functions as F

    t = decontaminate.templates(docs, "text", F.col("id"))
    got = decontaminate.filled(decontaminate.windows(t, ["id"], [4, 6], [1, 3])).collect()
    hashes, found = {}, set()
    for r in got:
        if r.code < decontaminate.LITERAL:
            found.add((r.id, r.pos, r.code, r.h, tuple(r.slots)))
    want = {}
    for i, text in enumerate(texts):
        for width in (4, 6):
            for pos, names, template, slots in slow_windows(text, width):
                want[i, pos, width << decontaminate.WINDOW | names] = (template, tuple(slots))
    assert {f[:3]: f[4] for f in found} == {k: v[1] for k, v in want.items()} and len(found) == len(want) > 500
    for f in found:  # equal hashes and equal templates are the same
        assert hashes.setdefault(f[3], want[f[:3]][0]) == want[f[:3]][0]
    assert len(set(hashes.values())) == len(hashes)
    literal, wanted = {}, {}
    for r in got:
        if r.code >= decontaminate.LITERAL:
            literal.setdefault(r.h, set()).add((r.id, r.pos))
    for i, text in enumerate(texts):
        values = [v for _, v in slow_marks(text)]
        for width in (1, 3):
            for pos in range(len(values) - width + 1):
                wanted.setdefault((width, *values[pos : pos + width]), set()).add((i, pos))
    assert sorted(map(sorted, literal.values())) == sorted(map(sorted, wanted.values()))


def test_many_hashes_give_the_same_rows(spark, monkeypatch):
    item = "The shop sells 12 red apples in the morning and then 15 green apples in the late evening."
    docs = spark.createDataFrame([(i, item.replace("12", str(i)) if i % 3 else "nothing of that") for i in range(20)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "Who wrote Hamlet?")], "item_id long, text string")
    few = sorted(tuple(r) for r in decontaminate.report(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "HASH_ROWS", 1)
    assert sorted(tuple(r) for r in decontaminate.report(docs, bench).collect()) == few
    assert [r[1] for r in few] == [i % 3 > 0 for i in range(20)]
