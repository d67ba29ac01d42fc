"""What a worker holds grows with what it has seen."""

import re
import tracemalloc
from functools import partial
from pathlib import Path
from types import SimpleNamespace

import numpy as np

from readloom.llm import quality, tokens
from readloom.llm.common import release_memory
from readloom.llm.queries import tokenizer_path
from readloom.llm.rangecoder import LONGEST, decode_blocks, encode_blocks
from readloom.llm.tokens import Encoder


def test_table_of_pieces_grows():
    e = Encoder(tokenizer_path())
    assert e.keys.nbytes + e.numbers.nbytes < 1 << 21
    lines = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(2500)]
    for turn in range(2):  # the second time all pieces are known
        known = e.known
        for at in range(0, len(lines), 250):
            ids, counts = e([x.encode() for x in lines[at : at + 250]])
            assert counts.sum() == len(ids)
            want = e.tokenizer.encode(lines[at], add_special_tokens=False).ids
            assert ids[: counts[0]].tolist() == want
        assert turn == 0 or e.known == known
    assert (e.keys[:, 0] != 0).sum() == e.held <= len(e.keys) / 2
    e.forget()
    assert e.held == 0 and e(["w1x1 w1x2".encode()])[0].tolist() == e.tokenizer.encode("w1x1 w1x2", add_special_tokens=False).ids


def test_coder_holds_few_bytes_an_id():
    lanes = 1024
    blocks = list((np.random.default_rng(5).zipf(1.3, (lanes, LONGEST)) % 60_000).astype(np.uint16))
    tracemalloc.start()
    try:
        codes = encode_blocks(blocks)
        coded = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        held = tracemalloc.get_traced_memory()[0]
        got = decode_blocks(codes, [LONGEST] * lanes)
        decoded = tracemalloc.get_traced_memory()[1] - held
    finally:
        tracemalloc.stop()
    assert all((a == b).all() for a, b in zip(got, blocks, strict=True))
    assert coded < 20 * lanes * LONGEST and decoded < 14 * lanes * LONGEST  # 32 and 24 where the tables of all blocks were made at once


def test_texts_come_to_the_encoder_in_small_batches(spark, monkeypatch, tmp_path):
    setting, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, write = spark.conf.get(setting), tokens.materialize
    monkeypatch.setattr(tokens, "materialize", lambda df, tag: (seen.append(int(spark.conf.get(setting))), write(df, tag))[1])
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(1500)], "doc_id long, text string").coalesce(1)
    manifest = tokens.write_tokens(docs, tokenizer_path(), 2, f"file://{tmp_path}/tok")
    assert seen and max(seen) <= 512 and spark.conf.get(setting) == before
    rows = tokens.read_tokens(manifest, f"file://{tmp_path}/tok", manifest.count())
    assert sorted(r.doc_id for r in rows.collect()) == list(range(1500))


def test_driver_gives_back_what_training_took(monkeypatch):
    def held():
        return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024

    def sample(*_):
        return [SimpleNamespace(text=" ".join(f"w{i * k % 9973}y{k}" for k in range(1500)), quality=i % 2) for i in range(500)], {0: 250, 1: 250}

    monkeypatch.setattr(quality, "training_rows", sample)
    monkeypatch.setattr(quality, "train", partial(quality.train, steps=500))
    release_memory()
    before = held()
    table, _ = quality.fit(None, None)
    assert np.abs(table).max() > 0 and held() - before < 25


def test_table_of_pieces_has_at_most_four_places_a_piece():
    e = Encoder(tokenizer_path())
    e([" ".join(f"w{i}x" for i in range(40_000)).encode()])
    assert e.held >= 40_000 and 2 * e.held <= len(e.keys) <= 4 * e.held
