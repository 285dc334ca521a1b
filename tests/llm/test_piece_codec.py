import random

import public_tokenizers
import pytest
import sentencepiece

from kassa.llm import piece_codec
from llm_helpers import docs_of

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = list("abcdefghijklmnopqrstuvwxyz   \n\n\t.,'\"-_(){}=+*éêüßñ0123456789ABCDE▁漢字語😀\x00\x85\xa0<>|") + [
    "  ", "<s>", "</s>", "<0x0A>", "the ", "ing ", " \n", "é"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts():
    draw = random.Random(4)
    out = ["".join(draw.choice(ALPHABET) for _ in range(draw.choice([0, 1, 2, 5, 20, 120]))) for _ in range(3000)]
    out += [" " * n for n in range(70)] + [" " * n + "the" + " " * n for n in range(70)] + ["a" * 5000, "the " * 3000]
    return out


def test_equals_library(library):
    codec = piece_codec.PieceCodec(MODEL)
    for t in texts():
        want = [library.bos_id(), *library.encode(t), library.eos_id()]
        got = codec.encode(t)
        assert got.tolist() == want, t
        assert codec.decode(got) == library.decode(want), t


def test_columns(spark, library):
    some = [*texts()[:200], None, "", None]
    docs = docs_of(spark, some)
    encode, decode = piece_codec.encoder(MODEL), piece_codec.decoder(MODEL)
    rows = docs.select("doc_id", encode("text").alias("ids")).withColumn("text", decode("ids")).collect()
    for r in rows:
        t = some[r["doc_id"]] or ""
        assert list(r["ids"]) == [1, *library.encode(t), 2]
        assert r["text"] == library.decode(library.encode(t))
    assert docs.limit(0).select(encode("text")).count() == 0
