"""The byte-level encoder in batches, and shard files read on their own."""

import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa

from keyloom.llm import byte_bpe, wavelet

from test_text_ops import ODD, docs, some_texts

FILE = P.path("byte_bpe_50k.json")


def odd_texts(n=400, seed=7):
    r = random.Random(seed)
    parts = ["a", "word", "Über", "naïve", ",", ".", " ", " ", "\n", "  ", "\t", "'s", "’", "12", "①", "é", "日本", "😀", "\x00", "", ".,", "x.y", "don't", "_", "K", "ǅ", " ", "​", "<|endoftext|>", "-"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_batches_equal_the_library(monkeypatch):
    monkeypatch.setattr(byte_bpe, "SLICE", 500)
    for memory in (0, 40, 500_000):
        coder = byte_bpe.ByteBPE(FILE, memory=memory)
        texts = ODD + odd_texts() + some_texts()
        for _ in range(2):  # the second time much is remembered
            for text, ids in zip(texts, coder.stream(pa.array(texts, pa.string())), strict=True):
                assert ids.tobytes() == coder.whole(text or ""), text
    assert list(coder.stream([])) == []


def test_a_very_long_word():
    r = random.Random(3)
    coder = byte_bpe.ByteBPE(FILE)
    text = "start " + "".join(r.choice("abcdefghijkl") for _ in range(200_000)) + " end."
    assert coder.ids(text) == coder.whole(text)


def test_a_shard_file_has_all_of_its_documents():
    r = np.random.default_rng(2)
    ids = [None, None, 5, 5, 9, (1 << 62) + 1]
    arrays = [np.append(r.integers(0, 50257, n), 2).astype(np.uint16) for n in (0, 700, 3, 0, 2000, 1)]
    file = wavelet.Shard.from_bytes(wavelet.Shard.of(77, ids, arrays, 16).to_bytes())
    assert file.docs == ids and file.before == 77 and file.lengths().tolist() == list(map(len, arrays))
    whole = file.matrix.decode()
    for k, want in enumerate(arrays):
        a, b = file.bounds(k)
        assert (whole[a:b] == want).all() and b - a == len(want)
        assert file.matrix.access(b - 1) == 2


def test_shard_tables_read_back_alone(spark):
    texts = ODD + some_texts(30)
    ids = [None, 9, 9, *range(100, 97 + len(texts))]
    rows = docs(spark, texts, ids)
    table = wavelet.write_shards(rows.withColumns({"part": rows.doc_id, "file": rows.text}), FILE, shard_ids=300)
    assert table.columns == ["part", "n_ids", "file"]
    found = [wavelet.Shard.from_bytes(r.file) for r in table.collect()]
    assert len(found) > 3 and sum(len(f.docs) for f in found) == len(texts)
    got = {}
    for f in found:
        whole = f.matrix.decode()
        for k, i in enumerate(f.docs):
            a, b = f.bounds(k)
            got.setdefault(i, []).append(whole[a:b].tobytes())
    coder = byte_bpe.encoder(FILE)
    want = {}
    for i, t in zip(ids, texts):
        want.setdefault(i, []).append(coder.whole(t or "") + b"\x02\x00")
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}


def test_long_words_are_counted_as_short_ones_and_in_time():
    import time

    import sentencepiece

    from keyloom.llm import token_counts

    r = random.Random(4)
    model = token_counts.PieceBPE(P.path("piece_bpe_32k.model"))
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for letters in ("ab", "abcde", "etaoinshr", "abcdefghijklmnopqrstuvwxyz", "aé日x\x00", "0123456789", "theandig", "=-_"):
        for _ in range(40):
            word = "▁" + "".join(r.choice(letters) for _ in range(r.randint(0, 300)))
            assert model.merge_long(word) == model.merge([word])[0]
    word = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    began = time.process_time()
    assert model.counts([word + " a " + word[:300]]) == [len(library.encode(word + " a " + word[:300]))]
    assert time.process_time() - began < 20  # some hours at one merge a round
