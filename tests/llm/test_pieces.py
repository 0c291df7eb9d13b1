import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from emberlog.llm import pieces
from helpers import DOCS, awkward, frame

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def odd_texts(n, seed=1):
    r = random.Random(seed)
    texts = ["", " ", "  a", "a ", "\n\n x", "▁", "a▁b", "日本語テキスト \u0000 x", "aaaa" * 50, "abab" * 77, "the" * 300, "�", "🎉🎉 é́"]
    for _ in range(n):
        texts += ["".join(r.choice(letters) for _ in range(r.randrange(1, 90)))
                  for letters in ("abcdeinorst  \n▁é日", "etaoins h", "0123456789=-_*#/\\ \t", "́eé🎉 \r\n")]
    return texts


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def model_file(path, normal, trainer=((3, 2), (35, 1)), normalizer=((3, 1), (4, 0), (5, 1))):
    """A model file with the given (piece, score), and all byte pieces."""
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256)), *((p, s, 1) for p, s in normal)]
    out = b""
    for piece, score, kind in rows:
        row = b"\x0a" + varint(len(piece.encode())) + piece.encode() + b"\x15" + struct.pack("<f", score) + b"\x18" + varint(kind)
        out += b"\x0a" + varint(len(row)) + row
    for field, values in ((2, trainer), (3, normalizer)):
        body = b"".join(varint(n << 3) + varint(v) for n, v in values)
        out += varint(field << 3 | 2) + varint(len(body)) + body
    with open(path, "wb") as f:
        f.write(out)
    return str(path)


def test_ids_and_texts_equal_the_librarys():
    encode, model = pieces.Encoder(pieces.load(PATH)), pieces.load(PATH)
    texts = odd_texts(400)
    for text, ids in zip(texts, encode(texts)):
        assert ids.tolist() == LIBRARY.encode(text), text
        assert pieces.decode_ids(model, ids).decode() == LIBRARY.decode(ids.tolist())


def one_by_one(model, text):
    """The rule itself: the best pair of a whole text, the leftmost of equals, again and again."""
    sym = [int(i) if (i := model.char_ids[ord(c)]) >= 0 else model.pieces + ord(c) for c in pieces.SPACE + text.replace(" ", pieces.SPACE)]
    table = dict(zip(model.pairs.tolist(), zip(model.ranks.tolist(), model.merged.tolist())))
    while True:
        best = min(((table[k][0], i, table[k][1]) for i, (a, b) in enumerate(zip(sym, sym[1:])) if (k := a * (model.pieces + pieces.CODES) + b) in table), default=None)
        if best is None:
            return sym
        sym[best[1]:best[1] + 2] = [best[2]]


@pytest.mark.parametrize("seed", range(12))
def test_vocabularies_whose_merges_disturb_one_another(tmp_path, seed):
    """Random pieces with random and equal scores, so that a merge often makes a pair that comes before those still open."""
    r = random.Random(seed)
    names = {"".join(r.choice("ab▁c") for _ in range(r.randrange(2, 7))) for _ in range(60)}
    if seed % 2:  # words end at blanks, as in most models
        names = {n.replace("▁", "") for n in names} | {"▁" + n.replace("▁", "") for n in names}
    names = sorted(n for n in names if len(n) > 1)
    path = model_file(tmp_path / "m.model", [*((c, -1000.0) for c in "ab▁"), *((n, -float(r.randrange(20))) for n in names)])
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), pieces.load(path)
    encode = pieces.Encoder(model)
    texts = ["".join(r.choice("aab bc d") for _ in range(r.randrange(1, 60))) for _ in range(150)]
    for text, ids in zip(texts, encode(texts)):
        assert ids.tolist() == library.encode(text)
        spelled = [i for s in one_by_one(model, text) for i in ([s] if s < model.pieces else model.byte_ids[list(chr(s - model.pieces).encode())].tolist())]
        assert ids.tolist() == spelled
        assert pieces.decode_ids(model, ids).decode() == library.decode(ids.tolist())


def test_any_ids_are_decoded_as_the_library_does():
    model, r = pieces.load(PATH), random.Random(3)
    for _ in range(3000):
        ids = [r.randrange(400) if r.random() < .7 else r.randrange(32000) for _ in range(r.randrange(0, 12))]
        assert pieces.decode_ids(model, np.array(ids)).decode() == LIBRARY.decode(ids)
    with pytest.raises(IndexError):
        pieces.decode_ids(model, np.array([32000]))


def test_long_words_and_forgotten_words(monkeypatch):
    r = random.Random(9)
    texts = ["".join(r.choice("etaoinshrdlu") for _ in range(5000)), *odd_texts(20)]
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    monkeypatch.setattr(pieces, "CHUNK", 50)
    encode = pieces.Encoder(pieces.load(PATH))
    for _ in range(3):
        assert [i.tolist() for i in encode(texts)] == [LIBRARY.encode(t) for t in texts]
        assert all(len(w) <= pieces.LONGEST for w in encode.known)


@pytest.mark.parametrize("trainer, normalizer", [(((3, 1), (35, 1)), ((4, 0),)), (((3, 2),), ((4, 0),)), (((3, 2), (35, 1)), ((4, 1),))])
def test_other_models_are_refused(tmp_path, trainer, normalizer):
    with pytest.raises(ValueError):
        pieces.load(model_file(tmp_path / "m.model", [("a", -1.0)], trainer, normalizer))


def test_awkward_rows(spark):
    docs = frame(spark, awkward()).withColumnRenamed("predicted", "IDS")
    coded = pieces.encode(docs, PATH)
    assert coded.columns == [c for c in docs.columns if c != "IDS"] + ["ids"]
    back = pieces.decode(coded, PATH, text="again")
    rows = back.collect()
    assert len(rows) == docs.count() and all(r.ids == LIBRARY.encode(r.text or "") and r.again == LIBRARY.decode(r.ids) for r in rows)
    found = pieces.digest(docs, PATH).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted(((r.doc_id is None, r.doc_id, len(r.ids), sha(",".join(map(str, r.ids))), sha(r.again)) for r in rows), key=str)
    assert sorted(((r.doc_id is None, *r) for r in found), key=str) == want
    assert pieces.decode(back.withColumn("ids", F.lit(None).cast("array<int>")), PATH).filter("text is not null").count() == 0


def test_empty_table(spark):
    docs = frame(spark, [], DOCS)
    assert pieces.encode(docs, PATH).count() == pieces.digest(docs, PATH).count() == 0
