"""Alignment of two tokenizations against a plain account by byte offsets."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spindle.llm import token_alignment, token_windows
from spindle.llm.queries import byte_tokenizer, piece_model
from spindle.llm.token_alignment import align_documents, aligned_documents
from spindle.llm.token_windows import WindowAligner, byte_letters

FOLDER = "/root/testdata/sf0.001"
TEXTS = [
    None,
    "",
    " ",
    "a",
    "Hello world, hello  world\n\n and\tmore 's it's 12345",
    "<|endoftext|> and <s> </s> <unk> <0x41>",
    "mark ▁ of a space",
    "naïve café — “quotes” … ¡olé! ž",
    "日本語のテキスト 混在 text",
    "é" * 300 + " " * 70 + "\n" * 40,
    "emoji 👩‍👩‍👧 ​ zero \x00 nul \x85 next",
    "word " * 3000,
    "x" * 3000,
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(byte_tokenizer())
    a.encode_special_tokens = True
    byte = {letter: b for b, letter in enumerate(byte_letters())}
    return a, {i: bytes(byte[c] for c in t) for t, i in a.get_vocab().items()}, sentencepiece.SentencePieceProcessor(model_file=piece_model())


def piece_bytes(b, i):
    return bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()


def plain(libraries, texts):
    """Everything from the byte ranges of all tokens."""
    a, bytes_of, b = libraries
    found, counts = [], Counter()
    for text in texts:
        ids_a = a.encode(f" {text}", add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        spelled = [[bytes_of[i] for i in ids_a], [piece_bytes(b, i) for i in ids_b]]
        if not text or any(b"".join(s) != f" {text}".encode() for s in spelled):
            found.append(((), (), [], ""))
            continue
        owner = [np.repeat(np.arange(len(s)), [len(t) for t in s]) for s in spelled]
        links = [(ids_a[i], ids_b[k]) for i, k in sorted(set(zip(*[o.tolist() for o in owner], strict=True)))]
        ends = [np.cumsum([len(t) for t in s]) for s in spelled]
        groups, i, k = [], 0, 0
        for end in np.intersect1d(*ends):
            j, m = (int(np.searchsorted(e, end)) + 1 for e in ends)
            groups.append(f"{','.join(map(str, ids_a[i:j]))}|{','.join(map(str, ids_b[k:m]))}")
            i, k = j, m
        counts.update(links)
        found.append((ids_a, ids_b, links, ";".join(groups)))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for ids_a, ids_b, links, groups in found:
        n_groups = groups.count(";") + 1 if groups else 0
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        out.append((len(ids_a), len(ids_b), n_groups, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return out


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def documents(spark, texts):
    rows = [(i, t, "x", "y", "z", "w") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, pairs string, times string, row string, pair string")


@pytest.mark.parametrize("hot", [1, 20, 200_000])
def test_odd_texts(spark, libraries, monkeypatch, hot):
    monkeypatch.setattr(token_alignment, "HOT", hot)
    want = sorted(((i, *r) for i, r in enumerate(plain(libraries, TEXTS))), key=repr)
    assert collected(aligned_documents(documents(spark, TEXTS), byte_tokenizer(), piece_model())) == want


def test_whole_sample(spark, libraries):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = sorted(((r["doc_id"], *p) for r, p in zip(rows, plain(libraries, [r["text"] for r in rows]), strict=True)), key=repr)
    assert collected(aligned_documents(docs.repartition(5), byte_tokenizer(), piece_model())) == want


def test_rows_without_id_repeated_rows_and_none(spark, libraries):
    texts = ["one text", "one text", "two", None]
    df = documents(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") > 2, None).otherwise(F.lit(1).cast("long")))
    want = sorted(((None if i > 2 else 1, *r) for i, r in enumerate(plain(libraries, texts))), key=repr)
    assert collected(aligned_documents(df, byte_tokenizer(), piece_model())) == want
    assert aligned_documents(df.limit(0), byte_tokenizer(), piece_model()).count() == 0


def test_groups_and_pairs_are_given(spark):
    row = align_documents(documents(spark, ["Unbelievable, unbelievable"]), byte_tokenizer(), piece_model()).first()
    assert row["groups"].count(";") == row["n_groups"] - 1
    assert row["pairs"] == sorted(set(row["pairs"])) and sum(row["times"]) >= max(row["n_a"], row["n_b"])


def test_long_texts_are_tokenized_in_parts_without_a_trace(monkeypatch):
    texts = ["Some words, and 12 numbers it's — naïve  two spaces\n" * 30, "nospace" * 400, "a b " * 500]
    whole = WindowAligner(byte_tokenizer(), piece_model())
    want = {n: [x.tolist() for x in ids] for n, ids in whole.tokens(texts).items()}
    monkeypatch.setattr(token_windows, "SEGMENT", 50)
    assert {n: [x.tolist() for x in ids] for n, ids in whole.tokens(texts).items()} == want and len(want) == 3
    assert sum(1 for _ in token_windows.parts_of(texts[0])) > 5


def test_windows_are_remembered_and_forgotten(monkeypatch):
    aligner = WindowAligner(byte_tokenizer(), piece_model())
    first = aligner.align(["the same words come again the same words", "and again the same"])
    known = len(aligner.memo)
    assert aligner.align(["again the same words"])[0][0] == 4 and len(aligner.memo) == known
    monkeypatch.setattr(token_windows, "REMEMBERED", 0)
    again = aligner.align(["the same words come again the same words", "and again the same"])
    assert len(aligner.memo) == 0
    assert [(*x[:4], x[4].tolist(), x[5].tolist()) for x in first] == [(*x[:4], x[4].tolist(), x[5].tolist()) for x in again]
