import random

import public_tokenizers
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from cloudloom.llm import sentencepiece_codec as sc

from .helpers import documents

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = list("abcdeéßñ .,'\n\t12345 ABC漢字語🙂ab  the ing  tion\x00́")


def _texts(seed, n):
    rnd = random.Random(seed)
    pieces = [p.replace(sc.MARK, "") for p in sc.vocabulary_of(PATH).pieces[300:]]
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(80))) for _ in range(n)] + [
        "".join(rnd.choice(pieces) + rnd.choice(["", " ", "  "]) for _ in range(rnd.randrange(1, 12))) for _ in range(n)
    ] + ["", " ", "   a", "a  ", "x" * 5000, "▁ ▁", "ab" * 3000]


def test_bpe_matches_library(monkeypatch):
    texts = _texts(1, 1500)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = library.encode(texts, num_threads=1)
    for block in (sc.BLOCK, 64):
        monkeypatch.setattr(sc, "BLOCK", block)
        got = sc.Encoder(sc.vocabulary_of(PATH)).encode(texts)
        assert [x.tolist() for x in got] == want
    decoded = [sc.vocabulary_of(PATH).decode(x) for x in got]
    assert decoded == library.decode(want)


def test_unigram_matches_library(tmp_path):
    model = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = sc.UNIGRAM
    for i, p in enumerate(model.pieces):
        p.score = -10 - 0.001 * i
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    v = sc.Vocabulary(path)
    texts = _texts(2, 400)
    for text, ids, want in zip(texts, sc.Encoder(v).encode(texts), library.encode(texts, num_threads=1)):
        # Equal scores may be reached by several paths; sums are rounded to single precision there.
        assert ids.tolist() == want or abs(float(v.score[ids].sum()) - float(v.score[want].sum())) < 0.01


def test_round_trip_operator(spark):
    rows = [(1, None, "s"), (2, "", "s"), (None, "déjà  vu\n", None), (3, "一二三 🙂 \x00", "s"), (3, "一二三 🙂 \x00", "s"), (4, "word " * 30000, "s")]
    docs = documents(spark, rows, extra=True)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = sc.encode(docs, PATH, "source")
    assert sorted(repr((r.doc_id, r.ids, r.source)) for r in got.collect()) == sorted(repr((i, library.encode(t or ""), s)) for i, t, s in rows)
    back = sc.decode(got, PATH, "source")
    assert sorted(repr((r.doc_id, r.text)) for r in back.collect()) == sorted(repr((i, t or "")) for i, t, _ in rows)
    assert sc.round_trip(docs, PATH).filter("same").count() == len(rows)
    assert sc.round_trip(documents(spark, []), PATH).count() == 0
