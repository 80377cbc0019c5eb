"""Byte-pair encoding against tiktoken, unigram counts against plain search and sentencepiece."""

import base64
import hashlib
import random

import pytest

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from pyspark.sql import functions as F  # noqa: E402

from recquarry.llm import byte_bpe, token_counts  # noqa: E402

BPE = P.path("byte_bpe_multi_50k.tiktoken")
UNIGRAM = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def reference():
    with open(BPE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n=4000, seed=5):
    rnd = random.Random(seed)
    parts = ["'", "''", "'s", "s", "t", "re", "ve", "ll", "d", " ", "  ", "\n", "\t", "　", "\x85", "\xa0", "1", "\xb2", "é", "世", "!", "$", "a", "B", "😀"]
    return ["", "'", " 's", "a's 't", "don't 's's''s", "  ", "a  \n b  "] + [
        "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 40))) for _ in range(n)
    ]


def test_encoding_is_tiktokens(reference):
    texts = [*odd_texts(), "x" * 3000 + "é" * 1000 + "abc" * 500, "na" * 200]
    for text, (ids, offsets) in zip(texts, byte_bpe.encode_batch(texts, BPE)):
        assert ids == reference.encode_ordinary(text)
        assert byte_bpe.decode(ids, BPE) == text.encode()
        assert len(offsets) == 0 or (offsets[0] == 0 and offsets[-1] < len(text))
        assert len(byte_bpe.token_offsets(ids, BPE)) == len(ids)


def test_scan_is_the_sequential_automaton():
    import numpy as np

    rnd = np.random.default_rng(1)
    then, of_class, from_free = byte_bpe.monoid()
    for n in (1, 63, 64, 65, 5000):
        kinds = rnd.integers(0, 6, n)
        state, want = byte_bpe.FREE, []
        for k in kinds:
            want.append(state)
            state = byte_bpe.TRANSITIONS[int(k)][state]
        got = from_free[byte_bpe.compose_before(of_class[kinds])]
        assert got.tolist() == want


def test_digests_of_odd_rows(spark, reference):
    texts = [None, "", "Hello there", "Hello there", "a" * 20000]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(None, "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = df.select("doc_id", byte_bpe.digests(df, BPE).alias("r")).select("doc_id", "r.*").collect()
    assert len(out) == len(rows)
    for r in out:
        text = "x" if r.doc_id is None else texts[r.doc_id] or ""
        ids = reference.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    empty = df.limit(0)
    assert empty.select(byte_bpe.digests(empty, BPE)).count() == 0
    ids = df.where("doc_id = 2").select(byte_bpe.encode(df, BPE).alias("r")).select("r.ids", "r.piece_offsets").first()
    assert ids.ids == reference.encode_ordinary("Hello there") and ids.piece_offsets == [0, 5]


def slow_best(word, vocabulary):
    """Plain forward search over all prefixes, first best path kept."""
    best = [(0.0, 0)] + [None] * len(word)
    for i in range(len(word)):
        alone = False
        for n in range(1, len(word) - i + 1):
            value = vocabulary.pieces.get(word[i : i + n])
            if value is not None:
                alone |= n == 1
                if best[i + n] is None or best[i][0] + value > best[i + n][0]:
                    best[i + n] = (best[i][0] + value, best[i][1] + 1)
        if not alone:
            width = len(word[i].encode()) if vocabulary.byte_fallback else 1
            total = best[i][0] + vocabulary.unknown
            if best[i + 1] is None or total > best[i + 1][0]:
                best[i + 1] = (total, best[i][1] + width)
    return best[-1]


def test_counts_are_the_plain_search():
    rnd = random.Random(2)
    for trial in range(60):
        letters = "abcé"
        pieces = {"".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 5))): -float(rnd.randrange(1, 6)) for _ in range(12)}
        pieces[token_counts.MARK] = -2.0
        vocabulary = token_counts.make_vocabulary(pieces, byte_fallback=trial % 2 == 0)
        counter = token_counts.Counter(vocabulary)
        for _ in range(40):
            word = token_counts.MARK + "".join(rnd.choice(letters + "x") for _ in range(rnd.randrange(1, 12)))
            assert counter.best_path(word) == slow_best(word, vocabulary)
        text = "ab  c a" + " " * 3
        whole = token_counts.MARK + text.replace(" ", token_counts.MARK)
        assert counter.count(text) == slow_best(whole, vocabulary)[1]


def test_counts_agree_with_sentencepiece():
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(UNIGRAM, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    counter = token_counts.counter(UNIGRAM)
    for text in ("the", "Hello there", "one two three", "l'été de la maison", "straight on"):
        assert counter.count(text) == len(library.nbest_encode_as_pieces(text, 8)[0])


def test_counts_agree_with_the_one_best_encoder_on_bounded_scores():
    """The file marks pieces that merges never choose by -1e9, beside which the library's single
    precision loses all other scores; bounded from below they leave its one-best encoder exact."""
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(UNIGRAM, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        if p.type == 1:
            p.score = max(p.score, -1e5)
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    pieces = {p.piece: p.score for p in model.pieces if p.type == 1}
    counter = token_counts.Counter(token_counts.make_vocabulary(pieces, model.trainer_spec.byte_fallback))
    rnd = random.Random(11)
    words = ["the", "and", "with", "l'été", "maison", "then", "other.\nThe", "x\tz", "世界", "Straße", "", "thor", "of", "1999", "😀"]
    for _ in range(300):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 120)))
        assert counter.count(text) == len(library.encode(text))


def test_counts_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "the"), (3, "the"), (None, "the")], "doc_id long, text string")
    got = df.select("doc_id", token_counts.count_tokens(df, UNIGRAM).alias("n")).collect()
    one = token_counts.counter(UNIGRAM).count("the")
    assert sorted((r.doc_id or 0, r.n) for r in got) == [(0, one), (1, 0), (2, 0), (3, one), (3, one)]
    assert df.limit(0).select(token_counts.count_tokens(df, UNIGRAM)).count() == 0
    long = spark.createDataFrame([(1,)], "doc_id long").select("doc_id", F.repeat(F.lit("word "), 50000).alias("text"))
    assert long.select(token_counts.count_tokens(long, UNIGRAM).alias("n")).first().n > 50000


def test_pieces_over_spaces_are_refused():
    with pytest.raises(ValueError):
        token_counts.make_vocabulary({"a" + token_counts.MARK: -1.0}, False)


def test_full_piece_cache_keeps_results(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_PIECES", 3)
    ranks, rnd = byte_bpe.read_ranks(BPE).by_bytes, random.Random(2)
    pieces = byte_bpe.Pieces(ranks)
    for _ in range(400):
        piece = "".join(rnd.choices("abé世 ", k=rnd.randint(1, 4)))
        assert pieces[piece] == byte_bpe.merge_piece(piece.encode(), ranks)
        assert len(pieces) <= 3 and len(pieces.older) <= 3
    long = "ab" * 40
    assert pieces[long] == byte_bpe.merge_piece(long.encode(), ranks) and long not in pieces


@pytest.mark.parametrize("size", [1, 5, 1000])
def test_text_parts_cover_a_column(size):
    import pyarrow as pa

    from recquarry.llm.common import text_parts

    texts = ["", None, "abc", "世界", "x" * 50, None, "a", "", "b"]
    for column in (pa.array(texts), pa.array(["zz", *texts])[1:], pa.array([], pa.string()), pa.array([None, None], pa.string())):
        parts = list(text_parts(column, size))
        assert [t for _, _, part in parts for t in part] == [t or "" for t in column.to_pylist()]
        assert [a for a, _, _ in parts] == [0, *(b for _, b, _ in parts)][: len(parts)]
        assert all(b - a == len(part) and (b - a == 1 or sum(len(t.encode()) for t in part) <= size) for a, b, part in parts)
