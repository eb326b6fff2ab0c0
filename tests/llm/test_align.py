"""The alignment of two tokenizers against a plain version that encodes whole texts and looks at every pair of tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quarry.llm import align

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DATA = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  ", "a  b", "a\n b", "a \n b", "a\n\n  b\t", "\n", "x▁y", "▁", "<|endoftext|> <s> </s> <unk>", "💥👩‍👩‍👧 zürich naïve", "a\x00b\x1c c\x85 d", "don't  we'll  see  x", "日本語 テキスト 中文",
    "<0x41> _ ＿", "a" * 500, "the the the the", "the the the the", "﻿bom", "tail　 ", "word " * 50 + "\n" * 5 + " end",
]


def whole(texts):
    """Per text (ids and byte ends of A, of B), or None without tokens."""
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    of = align.byte_alphabet()
    for t in texts:
        raw = (" " + (t or "")).encode()
        x, y = a.encode(raw.decode(), add_special_tokens=False).ids, b.encode(t or "")
        bx = [bytes(of[c] for c in a.id_to_token(i)) for i in x]
        by = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in y for p in [b.id_to_piece(i)]]
        if not t or b"".join(bx) != raw or b"".join(by) != raw:
            yield None
        else:
            yield [(i, int(e) - len(z), int(e)) for i, z, e in zip(x, bx, np.cumsum([len(z) for z in bx]), strict=True)], [(i, int(e) - len(z), int(e)) for i, z, e in zip(y, by, np.cumsum([len(z) for z in by]), strict=True)]


def plain(texts):
    found = list(whole(texts))
    links = [Counter((i, j) for i, s, e in f[0] for j, u, v in f[1] if s < v and u < e) if f else Counter() for f in found]
    held = Counter(p for x in links for p in x)
    most = {}
    for (i, _), n in held.items():
        most[i] = max(n, most.get(i, 0))
    out = []
    for f, x in zip(found, links, strict=True):
        if not f:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        cuts = sorted({e for *_, e in f[0]} & {e for *_, e in f[1]})
        groups, lo = [], 0
        for hi in cuts:
            groups.append("|".join(",".join(str(i) for i, _, e in side if lo < e <= hi) for side in f))
            lo = hi
        out.append((len(f[0]), len(f[1]), len(groups), sum(x.values()), sum(k for p, k in x.items() if held[p] == most[p[0]]), sum(k * held[p] for p, k in x.items()), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def test_alphabet():
    assert sorted(align.byte_alphabet().values()) == list(range(256)) and align.byte_alphabet()["Ġ"] == 32


@pytest.mark.parametrize("head, part", [(1 << 19, 250_000), (5, 7)])
def test_alignment(spark, head, part, monkeypatch):
    """Also with few pairs in the broadcast, and texts in parts of a few characters."""
    monkeypatch.setattr(align, "HEAD_PAIRS", head)
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect() if len(r.text) < 1500][:120]
    rows = [(i, t, "x", 7) for i, t in enumerate([*ODD, *texts])]
    d = spark.createDataFrame(rows, "doc_id long, text string, groups_sha256 string, pairs int")
    if part < 100:
        # functions of tasks look parts up in their own module, so parts are tried without Spark
        monkeypatch.setattr(align, "PART_CHARS", part)
        chunks = align.Chunks(*PATHS)
        got = [(r.n_a, r.n_b, r.n_groups, r.n_links, r.said.hexdigest(), sum(r.distinct()[1].tolist())) if r else (0, 0, 0, 0, "", 0) for r in align.rows_of(chunks, (t for _, t, *_ in rows))]
        assert got == [(a, b, g, n, sha, n) for a, b, g, n, _, _, sha in plain([t for _, t, *_ in rows])]
    got = {r.doc_id: r for r in align.op12_token_alignment(d.repartition(3), *PATHS).collect()}
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert {i: tuple(r[c] for c in names) for i, r in got.items()} == dict(enumerate(plain([t for _, t, *_ in rows])))


def test_extra_columns_and_empty_tables(spark):
    d = spark.createDataFrame([(None, "a b", "x", 7), (None, "a b", "y", 8)], "doc_id long, text string, lang string, n_best int")
    got = align.scored(d, *PATHS).collect()
    assert sorted((r.lang, r.n_best, r.count_sum) for r in got) == [("x", 2, 4), ("y", 2, 4)]
    assert align.op12_token_alignment(d.limit(0), *PATHS).collect() == []


def test_dividing_finds_all_common_ends():
    rng = random.Random(2)
    for n in (1, 2, 3, 10, 100, 3000):
        for _ in range(20):
            a, b = (np.array(sorted({*rng.sample(range(1, 3 * n), rng.randrange(n)), 3 * n}), np.int64) for _ in range(2))
            ends_a, ends_b = align.divide(*align.bisected(a, b), np.array([[0, len(a), 0, len(b)]]))
            both = np.intersect1d(a, b)
            assert a[ends_a - 1].tolist() == both.tolist() and b[ends_b - 1].tolist() == both.tolist()
