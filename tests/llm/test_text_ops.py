"""Operators on single documents against libraries and brute force."""

import random
import re
import zlib

import numpy as np
import pytest
import public_tokenizers as P
from pyspark.sql import functions as F

from keyloom.llm import byte_bpe, html_extract, licences, packing, token_counts, toxicity, wavelet

ODD = [
    None, "", " ", "  ", "a", " a", "a ", "\n", "\n\n", "a\n\nb", "a  b", "x \n y", "it's I'll 'tis", "x<|endoftext|>y", "<s> </s> <unk> <0x0A>", "日本語 テキスト", "😀😀 a",
    "a\tb\t c", "é à²³ ½x", "a\r\nb", "a b　 c", "..., ,.", "\x00\x01", "▁ ▁▁a", "word, word. word,\nWord", "é combining", "x" * 5000, "ab " * 3000, "AbC ÄÖ",
]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], DOCS)


def some_texts(n=60, seed=1):
    r = random.Random(seed)
    words = ["the", "Idiot", "naïve", "über", "don't", "42", "foo,", "bar.", "(x)", "日本", "cc", "by", "ÀÉ"]
    return [" ".join(r.choice(words) + r.choice(["", "", "\n", "er"]) for _ in range(r.randint(0, 80))) for _ in range(n)]


def test_byte_bpe_equals_library():
    coder = byte_bpe.ByteBPE(P.path("byte_bpe_50k.json"), memory=50)
    for text in ODD + some_texts():
        assert coder.ids(text) == coder.whole(text or "")


def test_piece_counts_equal_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = ODD + some_texts()
    assert token_counts.PieceBPE(P.path("piece_bpe_32k.model")).counts(texts) == [len(library.encode(t or "")) for t in texts]


def test_token_counts_query(spark):
    out = token_counts.token_counts(docs(spark, ODD, [None, 5, 5, *range(3, len(ODD))]), P.path("piece_bpe_32k.model"), limit=100).collect()
    assert len(out) == len(ODD) and {r.n_bytes for r in out if r.n_tokens == 0} == {0}
    assert all(r.over_limit == (r.n_tokens > 100) for r in out)
    assert token_counts.token_counts(docs(spark, []), P.path("piece_bpe_32k.model")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_pack_covers_every_id_once(seed):
    r = random.Random(seed)
    window = 64
    lengths = [r.choice([1, 7, 13, 51, 64, 63, 200, 1000, r.randint(1, 300)]) for _ in range(r.choice([1, 2, 300]))]
    pieces = packing.pack(lengths, window)
    covered = {}
    sequences = {}
    for doc, start, n, seq, offset in pieces:
        assert n > 0
        covered.setdefault(doc, []).append((start, start + n))
        sequences.setdefault(seq, []).append((offset, offset + n))
    for doc, n in enumerate(lengths):
        spans = sorted(covered[doc])
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    for spans in sequences.values():
        spans.sort()
        size = spans[-1][1]
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and size <= window and size & (size - 1) == 0
    assert packing.pack([], window) == []


def test_repeat_counts_fit():
    histogram = np.zeros(64, np.int64)
    histogram[[10, 54, 20, 44, 30, 34]] = [100, 90, 5, 7, 3, 3]
    combos = packing.combinations(histogram, 64)
    counts = packing.repeat_counts(histogram, combos)
    used = np.zeros(64, np.int64)
    for c, n in zip(combos, counts):
        assert sum(c) == 64
        for v in c:
            used[v] += n
    assert (used <= histogram).all() and used.sum() >= 0.9 * histogram.sum()


def test_pack_query(spark):
    texts = ODD + ["same"] * 50
    out = packing.pack_ids(docs(spark, texts, [None, 1, 1, *range(3, len(texts))]), P.path("byte_bpe_50k.json"), 64).collect()
    coder = byte_bpe.encoder(P.path("byte_bpe_50k.json"))
    ids = np.r_[np.frombuffer(coder.whole(texts[-1]), "<u2"), 0].astype("<u4")
    mine = [r for r in out if r.doc_id == len(texts) - 1]
    assert sum(r.length for r in mine) == len(ids) == mine[0].doc_tokens
    assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine)
    assert packing.pack_ids(docs(spark, []), P.path("byte_bpe_50k.json")).count() == 0
    with pytest.raises(ValueError):
        packing.pack_ids(docs(spark, []), "x", 100)


def test_wavelet_matrix():
    r = np.random.default_rng(0)
    for n, top in ((0, 10), (1, 1), (700, 3), (5000, 50257)):
        ids = r.integers(0, top, n).astype(np.uint16)
        ids[: n // 3] = 2
        m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids, 16).to_bytes())
        assert (m.decode() == ids).all()
        for i in range(0, n, 97):
            assert m.access(i) == ids[i]
            s = int(ids[i])
            lo, hi = sorted(r.integers(0, n + 1, 2).tolist())
            assert m.count(s, lo, hi) == (ids[lo:hi] == s).sum()
            at = np.flatnonzero(ids == s)
            k = int(r.integers(0, len(at)))
            assert m.locate(s, k) == at[k]
        with pytest.raises(IndexError):
            m.locate(60000, 0)
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix.from_bytes(b"nope")


def test_token_index(spark):
    texts = ODD + some_texts(30)
    ids = [None, 9, 9, *range(100, 97 + len(texts))]
    out = wavelet.token_index(docs(spark, texts, ids), P.path("byte_bpe_50k.json"), shard_ids=500).collect()
    coder = byte_bpe.encoder(P.path("byte_bpe_50k.json"))
    start = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    whole = {i: np.r_[np.frombuffer(coder.whole(t or ""), "<u2"), 2].astype("<u4").tobytes() for i, t in zip(ids, texts)}
    assert all(zlib.crc32(whole[r.doc_id]) == r.ids_crc32 for r in out if r.doc_id not in (9,))
    order = [r.doc_id for r in sorted(out, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: -1 if x is None else x)
    assert wavelet.token_index(docs(spark, []), P.path("byte_bpe_50k.json")).count() == 0


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def test_licences_against_brute_force(spark):
    texts = ODD + ["CC BY cc by-NC; General Public License. general public general public LICENSE", "All rights all RIGHTS reserved cc", "all rights reserved" * 3] + some_texts()
    out = {r.doc_id: r for r in licences.licence_scan(docs(spark, texts), spans=True).collect()}
    for i, t in enumerate(texts):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hits = [(k, label) for p, label in licences.BASE_PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = out[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(hits), min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None))
        assert r.base_labels == ",".join(sorted({h[1] for h in hits})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1


def test_licence_templates():
    scan = licences.Scanner().scan
    got = scan("x " + licences.TEMPLATES["mit"].replace("software", "Software", 1) + " y")
    assert got["labels"] == "mit" and got["score"] == 1.0 and got["spans"][0][1] == 1
    broken = licences.TEMPLATES["bsd"].replace("source and binary", "source, or binary")
    assert "bsd" in scan(broken)["labels"] and "bsd" not in scan(" ".join(reversed(broken.split())))["labels"]


def test_matching_statistics():
    r = random.Random(2)
    seqs = {f"s{k}": [r.choice([b"a", b"b", b"c"]) for _ in range(12)] for k in range(3)}
    a = licences.SuffixAutomaton(seqs)
    words = [r.choice([b"a", b"b", b"c", b"z"]) for _ in range(200)]
    grams = {tuple(s[i:j]) for s in seqs.values() for i in range(12) for j in range(i + 1, 13)}
    got = {at: n for at, _, n in a.statistics(words)}
    for at in range(len(words)):
        want = next((n for n in range(12, 0, -1) if n <= at + 1 and tuple(words[at - n + 1 : at + 1]) in grams), 0)
        assert got.get(at, 0) == want


PAGE = "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><a href=/>Home</a></nav><div class=\"ad\">Buy now, it is cheap today.</div><article><h1>Head &amp; more</h1><p>One   two\n three<br>four</p><div class='advert'>no no no</div><p>caf&eacute; &lt;b&gt; <b>bold</b><p>last</article><section id=comments><p>I agree with all of this.</p></section><footer>&copy; x</footer>"


def test_html():
    assert html_extract.extract(PAGE) == "Head & more\nOne two three four\ncafé <b> bold\nlast"
    for page in (None, "", "<nav><a>x</a></nav>", "<script>alert(1)", "<!-- c"):
        assert html_extract.extract(page) == ""
    assert html_extract.extract("plain words only") == "plain words only"
    assert html_extract.extract("<p>" + "w " * 50_000).count("w") == 50_000
    for page, main in html_extract.LABELLED:
        assert html_extract.extract(page) == main


def test_html_region_is_the_best():
    tokens = html_extract.Tokens(PAGE)
    w = html_extract.weights()
    gains = [w[html_extract._group(k)] * (len(t.split()) if html_extract._group(k) in ("word", "link", "boiler") else 1) for k, t in zip(tokens.kinds, tokens.texts)]
    lo, hi = html_extract.region(tokens)
    best = max(sum(gains[i:j]) for i in range(len(gains)) for j in range(i + 1, len(gains) + 1))
    assert sum(gains[lo:hi]) == pytest.approx(best)


def test_html_query(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 7), (1, "u", PAGE, 7), (None, None, None, None)], "page_id bigint, url string, html string, text int")
    out = html_extract.html_text(pages).collect()
    assert len(out) == 3 and {r.n_chars for r in out} == {0, len(html_extract.extract(PAGE))}


def test_grammar():
    model = toxicity.Model([b"grob"], [], dict(toxicity.PRIOR))
    reading = lambda t: [r for r, n in zip(toxicity.READINGS, model.features(t)) if n]
    assert reading("What an idiot.") == [] and reading("What an idiot, what a moron.") == ["repeated"]
    assert reading("You are a moron!") == ["aimed"]
    assert reading("You are not an idiot.") == ["negated"]
    assert reading("He said that idiot left.") == ["reported"] and reading("They claimed she is a loser") == ["reported"]
    assert reading("I will kill you") == reading("you know I will kill") == ["threat"]
    assert reading("They attack the problem.") == [] and reading("Not now. What an idiot. And a moron.") == ["repeated"]
    assert reading("du grober Kerl") == ["aimed"] and reading("grober Kerl") == reading("") == reading(None) == []
    assert 0 < model.score(None) < 0.3 < model.score("you idiot") < 1


def test_toxicity_learns_held_out_stems(spark):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = [r.choice(["lorem", "ipsum", "dolor", "sit"]) for _ in range(30)]
        if toxic:
            for at in r.sample(range(30), 2):
                words[at] = "zagri" + r.choice(["ka", "mo", "ten"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    d = spark.createDataFrame(rows + [(None, None), (5, "x")], "doc_id bigint, text string")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    out = toxicity.toxicity(d, lab).join(lab.filter("toxic is not null").withColumnRenamed("doc_id", "id"), F.col("doc_id") == F.col("id"), "left").collect()
    held = [x for x in out if x.held_out and x.toxic is not None and x.doc_id != 5]
    assert len(held) > 50 and all(x.predicted == x.toxic for x in held)
    none = [x for x in out if x.doc_id is None]
    assert len(none) == 1 and none[0].predicted == 0 and not none[0].held_out
    assert toxicity.toxicity(d.limit(0), lab).count() == 0
