"""The cached tokenizer gives the library's own ids; packing and the token files lose none."""

import random

import numpy as np
import pytest

from docflow.llm import packing, token_output
from docflow.llm.tokens import CachedTokenizer, crc32_u4, vocabulary_path

KINDS = [("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "space")]
ODD = ["", " ", "\n", "  a  b ", "a\n\nb", "a \nb\tc", "don't  we'll it's 'tis", " lead", "trail ", "<|endoftext|> x", "x<|y", "É́ é Σας ΣΑΣ", "J̌ ǰ", "ａ　ｂ", "a\x01b\x02c", "a\x1cb c", "日本 語\n中", "word,%%% a1b2 word.", "a…!!! b’s", "x y"]
DOCS = [(3, "the hand of the man, and\nthe rest."), (1, None), (2, ""), (7, "a " * 3000), (5, "Ünïcödé wörds don't stop."), (5, "Ünïcödé wörds don't stop."), (None, "no id")]


@pytest.mark.parametrize("name,cut", KINDS)
def test_ids_equal_the_library(name, cut):
    tok = CachedTokenizer(vocabulary_path(name), cut, most=50)
    r = random.Random(1)
    letters = list(" \n\tab's1é'.,<|>É́ABJ̌…")
    texts = ODD + ["".join(r.choices(letters, k=r.randint(0, 40))) for _ in range(1500)]
    raw = [t.encode() for t in texts]
    for _ in range(2):  # cold and warm
        assert [t for t, ids in zip(texts, tok.encode(raw)) if ids != tok.whole(t.encode())] == []


def docs(spark, rows=DOCS):
    return spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(rows)], "doc_id long, text string, part long")


def library(name, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(name)).encode(text or "", add_special_tokens=False).ids + [1]


def test_packing_cuts_gapless_windows(spark):
    rows = packing.pack(docs(spark), length=64).collect()
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append(r)
    for s, own in seqs.items():
        own.sort(key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in own])
        assert [r["offset"] for r in own] == [0, *ends[:-1]]
        assert ends[-1] == 64 or s == max(seqs)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["ids"], r["doc_tokens"], r["ids_crc32"]))
    for doc, text in {d: t for d, t in DOCS}.items():
        pieces = sorted(by_doc[doc])
        want = library("byte_bpe_50k.json", text) * (2 if doc == 5 else 1)
        got = np.concatenate([np.frombuffer(p[1], "<u4") for p in pieces])
        assert sorted(got.tolist()) == sorted(want)
        assert all(p[3] == crc32_u4(np.frombuffer(p[1], "<u4")) for p in pieces)


def test_token_files_round_trip_in_doc_order(spark):
    got = sorted(token_output.token_output(docs(spark)).collect(), key=lambda r: r["start"])
    keys = [r["doc_id"] for r in got]
    assert keys == [None, 1, 2, 3, 5, 5, 7]
    at = 0
    texts = dict(DOCS)
    for r in got:
        want = library("word_bpe_49k.json", texts[r["doc_id"]])
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["start"] == at and r["n_tokens"] == len(want) and r["ids_crc32"] == crc32_u4(np.array(want))
        at += len(want)


def test_value_code_round_trip():
    v = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1] * 3 + [5], np.uint32)
    control, data = token_output.encode_values(v)
    assert len(control) == -(-len(v) // 4) and (token_output.decode_values(control, data, len(v)) == v).all()
    assert token_output.decode_values(*token_output.encode_values(v[:0]), 0).size == 0


def test_empty_tables(spark):
    none = docs(spark, [])
    assert packing.pack(none).count() == 0
    assert token_output.token_output(none).count() == 0


def test_token_files_are_read_in_another_process(spark, tmp_path):
    """From the folder alone, without Spark or anything that the writer held."""
    import subprocess
    import sys

    token_output.write_tokens(docs(spark), f"file://{tmp_path}/files", vocabulary_path("word_bpe_49k.json"), "space")
    code = f"""
import numpy as np, pyarrow.parquet as pq
from docflow.llm.token_output import decode_values
ranks = sorted(zip(*(c.to_pylist() for c in pq.read_table({str(tmp_path)!r} + "/files/ranks").columns)))
ids = np.array([i for _, i in ranks])
for b in sorted(pq.read_table({str(tmp_path)!r} + "/files/blocks").to_pylist(), key=lambda b: (b["shard"], b["first_token"])):
    print(*ids[decode_values(b["control"], b["data"], b["n_tokens"])], end=" ")
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout
    want = [i for d, t in sorted(DOCS, key=lambda x: (x[0] is not None, x[0] or 0)) for i in library("word_bpe_49k.json", t)]
    assert list(map(int, said.split())) == want
