"""Toxicity, decontamination, URL filter and language identification."""

import itertools
import random

import numpy as np
import pytest

from recquarry.llm import decontaminate, language_id, toxicity, url_filter


def words(rnd, n, letters="abcdefgh"):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(2, 7))) for _ in range(n))


# toxicity


@pytest.fixture(scope="module")
def decoder():
    known = "the cat sat on a mat and it was an idiot who ate stupid trash like some loser moron " * 40
    return toxicity.Decoder(toxicity.trigram_model(toxicity.trigram_counts([known])))


@pytest.mark.parametrize(
    "disguised, plain",
    [("1d10t", "idiot"), ("m0r0n", "moron"), ("l0s3r", "loser"), ("i d i o t", "idiot"), ("s.t.u.p.i.d", "stupid"), ("trrrrash", "trash"), ("$tup!d", "stupid")],
)
def test_readings(decoder, disguised, plain):
    assert decoder.read(disguised) == plain


def test_spans(decoder):
    text = "an 1d10t and m o r o n here, looooser 1234 5 ok"
    points, _ = toxicity.code_points([text])
    assert sorted(toxicity.disguised_spans(text, points[:-1])) == ["1d10t", "looooser", "m o r o n"]
    assert toxicity.prepared(["", "x", text], decoder)[:2] == ["", "x"]


@pytest.mark.parametrize(
    "text, plain",
    [
        ("you 1 d 1 0 t here", "idiot"), ("iidiioott", "idiot"), ("st.upid", "stupid"), ("id-iot", "idiot"), ("i  d  i  o  t", "idiot"),
        ("i,d,i,o,t", "idiot"), ("i/d/i/o/t", "idiot"), ("m o r 0 n", "moron"), ("m-o-r-0-n", "moron"), ("a m o r o n", "moron"), ("s t u p ! d", "stupid"),
    ],
)
def test_disguises_reach_the_decoder(decoder, text, plain):
    points, _ = toxicity.code_points([text])
    assert plain in toxicity.restore(text, decoder, points[:-1])


def test_symbols_for_a_word():
    for text, spans in (("an @$$ here", ["@$$"]), ("@@@ !!! $100 455 £3.50", [])):
        points, _ = toxicity.code_points([text])
        assert toxicity.disguised_spans(text, points[:-1]) == spans


@pytest.mark.parametrize("text", ["$100 or 1,250 and 3.5, 1 2 3 4 5", "don't it's 12:30 2024-01-05", "1. x = 2; 4 5 6 7 8", "a b", "1 a 2", "हिन्दी में लिखा"])
def test_plain_texts_are_not_disguised(text):
    points, _ = toxicity.code_points([text])
    assert toxicity.disguised_spans(text, points[:-1]) == []


def slow_reading(span, trigrams):
    """Cost of the best of all readings, one after the other."""
    table, size = toxicity._letter_table(), toxicity.LETTERS
    choices = []
    run = 0
    for i, c in enumerate(span):
        run = run + 1 if i and c == span[i - 1] else 0
        options = [(c, 0.0)] if table[ord(c)] else []
        options += [(x, toxicity.COST_SUBSTITUTE) for x in toxicity.LEET.get(c, "")]
        if c in toxicity.SEPARATORS:
            options.append(("", toxicity.COST_SEPARATOR))
        elif run:
            options.append(("", toxicity.COST_DOUBLE if run == 1 else toxicity.COST_REPEAT))
        elif not table[ord(c)]:
            options.append(("", toxicity.COST_DROP))
        choices.append(options)
    best = {}
    for path in itertools.product(*choices):
        word = "".join(x for x, _ in path)
        at = [0, 0, *(int(table[ord(x)]) for x in word), 0]
        total = sum(float(trigrams[(a * size + b) * size + c]) for a, b, c in zip(at, at[1:], at[2:])) - sum(cost for _, cost in path)
        best[word] = max(total, best.get(word, total))
    return best


def test_readings_are_the_best_of_all(decoder):
    rnd = random.Random(4)
    for _ in range(150):
        span = "".join(rnd.choice("idot1100!@$*. -6aa") for _ in range(rnd.randrange(1, 8)))
        best = slow_reading(span, decoder.trigrams)
        assert best[decoder.viterbi(span)] == pytest.approx(max(best.values()), abs=1e-6), span


def test_counts_are_the_slow_ones(decoder):
    texts = ["an idiot", "x" * 41 + " " + "x" * 42, "idiot 1d10t", "", "été"]
    counts = toxicity.document_counts(texts, np.array([1, 0, 0, 1, 0]), decoder)
    for k, label in ((0, [1, 2, 4]), (1, [0, 3])):
        want = np.zeros(1 << toxicity.FEATURE_BITS, np.int64)
        for i in label:
            want[list(set(toxicity.word_features(toxicity.prepared([texts[i]], decoder))[1].tolist()))] += 1
        assert (counts[k] == want).all()
    long = [toxicity.word_features(["x" * n])[1].tolist() for n in (40, 41, 42, 100_000)]
    assert len({x[-1] for x in long}) == 4  # whole words


def test_scores_do_not_depend_on_partitions(spark):
    rows = toxic_corpus(200)
    rows += [(1000 + i, rows[i % 7][1], rows[i % 7][2]) for i in range(60)]
    got = []
    for parts in (1, 7):
        docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(parts)
        model = toxicity.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
        got.append({r.doc_id: r.s for r in docs.select("doc_id", toxicity.score(docs, model).alias("s")).collect()})
    assert got[0] == pytest.approx(got[1])


def toxic_corpus(n=600):
    rnd = random.Random(3)
    bad = ["idiot", "stupid", "moron", "loser"]
    rows = []
    for i in range(n):
        text, toxic = words(rnd, rnd.randrange(20, 80), "etaoinshrdlu").split(), int(i % 4 == 0)
        if toxic:
            for _ in range(3):
                text.insert(rnd.randrange(len(text)), rnd.choice(bad))
        rows.append((i, " ".join(text), toxic))
    return rows


def test_scores(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t, 0) for i, t, _ in rows], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5] + [(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scored = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.score(docs, model).alias("s")).collect()}
    held = [(i, y) for i, _, y in rows if i % 5 == 0]
    assert sum((scored[i] >= 0.5) == bool(y) for i, y in held) / len(held) > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "!!!"), (4, "a 1d10t and a m0r0n, st0pid")], "doc_id long, text string")
    got = {r.doc_id: r.s for r in odd.select("doc_id", toxicity.score(odd, model).alias("s")).collect()}
    assert got[1] == got[2] == got[3] < 0.5 <= got[4] <= 1
    assert odd.limit(0).select(toxicity.score(odd, model)).count() == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.s for r in docs.select(toxicity.score(docs, model).alias("s")).collect()] == [0.0, 0.0]


# decontamination


ITEM = "Anna buys 12 apples at the old market and pays 30 dollars. How much does one apple cost when Anna gets 2 kg for free?"
OTHER = "A train leaves the northern station at noon and reaches the coast after seven slow hours of travel through hills."


def judged(spark, texts, items, **more):
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: r for r in decontaminate.report(docs, bench, **more).collect()}, docs, bench


def test_templates(spark):
    around = words(random.Random(1), 40) + ". {} " + words(random.Random(2), 40)
    changed = ITEM.replace("Anna", "Berta").replace("12", "17").replace("30", "1,250").replace("kg", "km")
    texts = [around.format(ITEM), around.format(changed), around.format("x"), None, "", ITEM[:40], around.format(OTHER.upper()), ITEM + " " + changed]
    got, docs, bench = judged(spark, texts, [(1, ITEM), (1, ITEM), (2, OTHER), (3, None), (4, "too short")])
    assert [got[i].contaminated for i in range(len(texts))] == [True, True, False, False, False, False, True, True]
    assert all(len(r) == 4 for r in got.values())
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3, 4, 5]


def test_slots_are_consistent(spark):
    item = ITEM.replace("Anna buys", "Yesterday Anna bought")
    same, other = item.replace("Anna", "Berta"), item.replace("Anna", "Berta", 1)
    got, _, _ = judged(spark, [same, other], [(1, item)])
    # a name of the item that stands for two names breaks the alignment
    assert [got[i].contaminated for i in (0, 1)] == [True, False]


def test_short_items_and_no_items(spark):
    got, docs, bench = judged(spark, ["we saw the green whale twice", "nothing here at all"], [(1, "the green whale twice")])
    assert [got[i].contaminated for i in (0, 1)] == [True, False]
    none, docs, bench = judged(spark, ["some text of many plain words here"], [])
    assert not none[0].contaminated
    assert decontaminate.report(docs.limit(0), bench).count() == 0


def test_items_without_wide_windows(spark):
    items = ["What is 12 times 15?", "Solve 2x + 3 = 7.", "Compute 3 + 4 * 5 - 6.", "Who wrote Hamlet?", "Add 1 2 3 4 5 6 7 8"]
    around = "some words in front of it. {} and more words behind"
    texts = [around.format(i) for i in items] + [around.format(items[0].replace("12", "13")), around.format("add 1 2 3 4 5 6 7 9")]
    got, _, _ = judged(spark, texts, list(enumerate(items)))
    assert [got[i].contaminated for i in range(len(texts))] == [True] * 5 + [False] * 2


def test_names_at_sentence_beginnings(spark):
    items = [
        "Sam reads 12 pages a day. Sam sleeps 8 hours. Kim walks 3 km home.",
        "Tom has 5 apples. Anna has 7 pears. Tom gives Anna 2 apples. How many apples does Anna have?",
    ]
    texts = [
        "Lea reads 15 pages a day. Lea sleeps 7 hours. Max walks 4 km home.",
        "Ben has 6 apples. Lisa has 9 pears. Ben gives Lisa 3 apples. How many apples does Lisa have?",
        items[1].lower(),
    ]
    got, _, _ = judged(spark, texts, list(enumerate(items)))
    assert [got[i].contaminated for i in range(3)] == [True] * 3


def test_one_other_number_leaves_the_rest(spark):
    item = "The shop sells 12 red apples in the morning and then 12 green apples in the late evening to people from town."
    texts = [item.replace("12", "13", 1), item.replace("12", "7", 1).replace("12", "9", 1), item]
    got, _, _ = judged(spark, texts, [(1, item)])
    assert [got[i].contaminated for i in range(3)] == [True] * 3
    assert got[0].share < 1 == got[2].share


# URLs


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def slow_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    best = None
    for kind, rule in RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = (kind, rule)
    return host, path, best


URLS = [
    None, "", "no scheme", "http://", "http://A.COM", "http://a.com/", "https://x.Example.com/en/1?q#f", "https://www.example.com/en/a/b#c",
    "http://a.b.www.example.com/en/", "http://example.com/enx", "ftp://q.net/es/", "http://net/fr/?", "http://notnet/fr/", "http://a.org?x=/y",
    "http://a.com#frag/", "http://x.com/a://b/c", "http://ÄB.com/ü", "http://spam.org/buy\nnow", "http://a.com//",
]


def test_urls(spark):
    rnd = random.Random(6)
    urls = URLS + [f"http://{words(rnd, 1)}.com/{words(rnd, 1)}/{rnd.randrange(99)}" for _ in range(60)]
    urls += [f"http://{words(rnd, 1, 'xyzw')}.net/es/{words(rnd, 1, 'xyzw')}" for _ in range(60)]
    tests = ["http://abcd.org/gabe", "http://xyzw.org/zyxw"]
    df = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls + tests)], "page_id long, url string, verdict string")
    got = {r.page_id: r for r in url_filter.judge(df, RULES).collect()}
    for i, u in enumerate(urls):
        host, path, rule = slow_rule(u)
        assert (got[i].host, got[i].path) == (host, path)
        assert got[i].rule == (rule[1] if rule else None)
        assert got[i].verdict == rule[0] if rule else got[i].verdict in ("allow", "block")
    assert (got[len(urls)].verdict, got[len(urls) + 1].verdict) == ("allow", "block")
    assert url_filter.judge(df.limit(0), RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(df, []).collect()} == {"allow"}


def test_url_models_are_the_slow_sums(spark):
    """Ratios of four-character strings against direct counting."""
    texts = [("\u0002\u0002\u0002abab\u0003", 2, 0), ("\u0002\u0002\u0002abc\u0003", 1, 3), ("\u0002\u0002\u0002bca\u0003", 0, 1)]
    df = spark.createDataFrame(texts, "text string, allow long, block long")
    got = {r.gram: r.ratio for r in url_filter.ratios(df).collect()}
    grams = {}
    for t, a, b in texts:
        for i in range(len(t) - 3):
            x = grams.setdefault(t[i : i + 4], [0, 0])
            x[0] += a
            x[1] += b
    letters = len({g[-1] for g in grams})
    for g in grams:
        logs = []
        for k in (0, 1):
            p = 1.0 / letters
            for n in range(1, 5):
                count = sum(v[k] for h, v in grams.items() if h[4 - n :] == g[4 - n :])
                context = sum(v[k] for h, v in grams.items() if h[4 - n : 3] == g[4 - n : 3])
                p = (count + 4.0 * p) / (context + 4.0)
            logs.append(np.log(p))
        assert got[g] == pytest.approx(logs[0] - logs[1])


# languages


def test_languages(spark):
    rnd = random.Random(9)
    letters = {"aa": "abcde", "bb": "fghij", "cc": "acegi"}
    rows = [(i, words(rnd, rnd.randrange(1, 60), letters[k]), k) for i, k in enumerate(list(letters) * 80)]
    train = spark.createDataFrame(rows + [(-1, "abc", None), (-2, None, "aa")], "doc_id long, text string, lang string")
    model = language_id.fit(train)
    fresh = [(k, words(rnd, 30, letters[k])) for k in list(letters) * 30]
    odd = [(None, None), (None, ""), (None, "12 !?"), ("aa", "abc " * 60000)]
    df = spark.createDataFrame([(i, t, "zz") for i, (_, t) in enumerate(fresh + odd)], "doc_id long, text string, lang_pred string")
    got = {r.doc_id: r.r for r in df.select("doc_id", language_id.identify(df, model).alias("r")).collect()}
    assert [got[i].lang_pred for i in range(len(fresh))] == [k for k, _ in fresh]
    assert [got[len(fresh) + i].lang_pred for i in range(3)] == ["und"] * 3
    assert got[len(fresh) + 3].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got.values())
    nothing = language_id.fit(train.limit(0))
    assert df.select(language_id.identify(df, nothing).alias("r")).where("r.lang_pred <> 'und'").count() == 0
    assert df.limit(0).select(language_id.identify(df, model)).count() == 0


def test_languages_are_the_slow_sums():
    texts = ["ab", "b", ""]
    model = language_id.Model(["x", "y"], np.log(np.random.default_rng(1).random((2, 1 << language_id.BUCKET_BITS))).astype("f4"), np.zeros(2))
    got = language_id.score_texts(model, texts)
    for i, t in enumerate(texts):
        points = np.array([ord(c) for c in t + "\n"], np.uint32)
        for k in (0, 1):
            want = sum(float(model.log_prob[k][language_id.hashed_ngrams(points[j : j + n], n)[0]]) for n in language_id.ORDERS for j in range(len(points) - n + 1))
            assert got[i, k] == pytest.approx(want, rel=1e-5)
