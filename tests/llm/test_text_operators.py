"""The operators over documents against brute force, on rows with every odd case."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_rows import SCHEMA as docs_schema
from llm_rows import docs, no_docs, ready, rows  # noqa: F401
from pyspark.sql import functions as F

from flotilla.llm import blocks, fertility, line_crf, lm_scores, minhash, mixing, phrase_dedup, pieces, stars, suffix_dedup, tables
from flotilla.llm.suffix_array import suffix_array

split = lambda text: (text or "").encode().split()
sha = lambda data: hashlib.sha256(data).hexdigest()
LEAST = -(1 << 63)
place = lambda key: LEAST if key is None else key


@pytest.fixture(scope="module")
def one_id(ready, rows):
    """A third of the rows and more without an id and many under one, far more than a block each."""
    drawn = [(None if i % 5 < 2 else 2**62 + i % 2 if i % 5 == 2 else r[0], *r[1:]) for i, r in enumerate(rows)]
    return drawn, ready.createDataFrame(drawn, docs_schema).repartition(4, "doc_id", "text")


def test_blocks_are_bounded(one_id):
    """Rows of one id, or of none, go to several blocks; only a row, or rows alike, can be more than a block."""
    drawn, df = one_id
    limit = 6000
    dealt, pieces, split = blocks.with_blocks(df, "doc_id", "text", limit)
    assert pieces >= 4 and len(split) == 2  # two ids that are one double are one range
    held: dict[int, list] = defaultdict(list)
    for r in dealt.collect():
        held[r.block].append((r.doc_id, r.text or ""))
    assert sum(map(len, held.values())) == len(drawn) and len({b for b, own in held.items() if (None in {k for k, _ in own})}) >= 4
    sizes = {b: sum(len(t.encode()) for t in {t for _, t in own}) for b, own in held.items()}
    largest = max(len((r[1] or "").encode()) for r in drawn)
    assert all(size <= 2 * limit + largest for size in sizes.values())
    order = [(b // pieces, place(k)) for b, own in held.items() for k, _ in own]
    assert all(max(k for r, k in order if r == a) < min(k for r, k in order if r == b) for a in {r for r, _ in order} for b in {r for r, _ in order} if a < b)


def test_phrases_of_one_id(one_id):
    check_phrases(one_id[1], one_id[0])


def test_byte_strings_of_one_id(one_id):
    check_byte_strings(one_id[1], one_id[0])


def test_stupid_backoff_of_one_id(one_id):
    check_backoff(one_id[1], one_id[0])


def test_phrases(docs, rows):
    check_phrases(docs, rows)
    found = phrase_dedup.remove_repeats(docs, block_bytes=3000)
    assert set(found.columns) == set(docs.columns) | {"kept_text", "n_removed", "n_factors"}  # n_words replaces the input's
    untouched = {r.doc_id: r.kept_text for r in found.where("n_removed = 0").collect()}
    assert untouched[0] == rows[0][1]


def check_phrases(docs, rows):
    earliest: dict[tuple, tuple] = {}
    for key, text, *_ in rows:
        words = split(text)
        for s in range(len(words) - 19):
            at = (place(key), s)
            gram = tuple(words[s:s + 20])
            earliest[gram] = min(earliest.get(gram, at), at)
    expected = Counter()
    for key, text, *_ in rows:
        words = split(text)
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            if earliest[tuple(words[s:s + 20])] < (place(key), s):
                gone[s:s + 20] = [True] * 20
        expected[key, text is None, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g)] += 1
    found = phrase_dedup.remove_repeats(docs, block_bytes=3000)
    assert Counter((r.doc_id, r.kept_text is None, r.n_words, r.n_removed, b" ".join(split(r.kept_text))) for r in found.collect()) == expected
    assert sum(k[3] for k in expected) > 500


def test_phrase_text_keeps_lines(ready):
    shared = " ".join(f"s{i}" for i in range(25))
    out = phrase_dedup.without_repeats(ready.createDataFrame([(1, shared), (2, f"first line\n{shared}\nlast\tline\n")], "doc_id long, text string"))
    assert {r.doc_id: r.text for r in out.collect()} == {1: shared, 2: "first line\nlast\tline\n"}


def test_byte_strings(docs, rows):
    check_byte_strings(docs, rows)


def check_byte_strings(docs, rows):
    count = Counter()
    for _, text, *_ in rows:
        data = (text or "").encode()
        count.update(data[s:s + 200] for s in range(len(data) - 199))
    expected = Counter()
    for key, text, *_ in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 199):
            if count[data[s:s + 200]] > 1:
                gone[s:s + 200] = b"\1" * 200
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        expected[key, len(data), sum(gone), spans, sha(bytes(b for b, g in zip(data, gone, strict=True) if not g))] += 1
    found = suffix_dedup.remove_repeats(docs, block_bytes=3000).collect()
    assert Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in found) == expected
    assert any(0 < k[2] < k[1] for k in expected)


@pytest.mark.parametrize("seed", range(40))
def test_suffix_array(seed):
    rnd = np.random.default_rng(seed)
    data = rnd.integers(0, int(rnd.choice([1, 2, 3, 9])) + 1, int(rnd.integers(1, 200))).astype(np.uint8).tobytes()
    found = suffix_array(np.frombuffer(data, np.uint8).astype(np.int16) + 1)
    assert list(found) == sorted(range(len(data)), key=lambda i: data[i:])


def shingles(text) -> set:
    words = [w.lower() for w in split(text)]
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def expected_components(rows) -> Counter:
    """Nodes are ids; texts are linked by their own sets."""
    sets = [(place(key), shingles(text)) for key, text, *_ in rows]
    parent = {i: i for i in range(len(sets))}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j][1])
            if both and 100 * both >= 75 * (len(a) + len(sets[j][1]) - both):
                parent[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 62)
    for i, (key, _) in enumerate(sets):
        least[find(i)] = min(least[find(i)], key)
    public = lambda key: None if key == LEAST else key
    return Counter((public(key), len(own), public(least[find(i)]), key == least[find(i)]) for i, (key, own) in enumerate(sets))


def test_near_duplicates(docs, rows):
    found = Counter(tuple(r) for r in minhash.near_duplicates(docs).collect())
    assert found == expected_components(rows)
    dropped = Counter(r.doc_id for r in minhash.drop_near_duplicates(docs).collect())
    assert dropped == Counter({key: n for key, n in Counter(r[0] for r in rows).items() if any(f[0] == key and f[3] for f in found)})


def test_near_duplicates_under_one_id(ready):
    """Null and repeated ids link nothing, and of copies under them one row stays."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    near = one.replace("a39", "a0")
    rows = [(None, one, 0), (None, one, 0), (None, two, 0), (None, near, 1), (5, two, 1), (5, three, 2), (5, three, 2), (6, one, 3), (7, None, 4), (7, None, 4), (7, " ", 4)]
    df = ready.createDataFrame(rows, "doc_id long, text string, n int").repartition(4)
    assert minhash.one_of_each(df).columns == df.columns
    stay = Counter(tuple(r) for r in minhash.one_of_each(df).collect())
    ones = [r for r in stay if r[1] in (one, near)]
    assert len(ones) == 1 and ones[0][0] is None and stay.pop(ones[0]) == 1
    assert stay == Counter({(None, two, 0): 1, (5, three, 2): 1, (7, None, 4): 2, (7, " ", 4): 1})
    found = Counter((r.id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect())
    assert found[5, 36, 5] == 2 and found[5, 36, None] == 1 and found[None, 36, None] == 4 and found[6, 36, None] == 1


def test_variants_of_one_text(ready):
    """Variants that are near the base but not near each other: the centre isn't the least id, and the rest must be compared too."""
    import random

    rnd = random.Random(3)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(60):
        words = list(base)
        for k in range(rnd.choice([0, 4, 6, 7, 9])):
            words[rnd.randrange(300)] = f"v{i}_{k}"
        rows.append((i, " ".join(words)))
    df = ready.createDataFrame(rows, "doc_id long, text string")
    old, minhash.CHUNK = minhash.CHUNK, 7
    try:
        assert Counter(tuple(r) for r in minhash.near_duplicates(df).collect()) == expected_components(rows)
    finally:
        minhash.CHUNK = old


def test_components(ready):
    path = [(i + 1, i) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 300), (300, 250)]
    found = {tuple(r) for r in stars.components(ready.createDataFrame(path, "a long, b long")).collect()}
    assert found == {(i, 0) for i in range(1, 41)} | {(101, 100), (250, 200), (300, 200)}


def test_fertility(docs, rows):
    found = fertility.judged(docs)
    by_row = Counter()
    for key, text, *_ in rows:
        words = split(text)
        grams = [tuple(words[s:s + 8]) for s in range(len(words) - 7)]
        often, marks = Counter(grams), set()
        for s, gram in enumerate(grams):
            if often[gram] > 1:
                marks |= set(range(s, s + 8))
        lines = [line for line in (text or "").encode().split(b"\n") if line.split()]
        chars = sum(len(w.decode()) for w in words)
        symbols = sum((text or "").count(c) for c in "#*$%&|<>")
        failed = len(words) < 20 or 100 * len(marks) > 30 * len(words)
        by_row[key, len(words), chars, symbols, len(lines) - len(set(lines)), len(marks), failed] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found.collect()) == by_row
    assert not found.where("kept and base_failed").count()
    assert fertility.kept(docs).columns == docs.columns


def test_fertility_measures():
    from pathlib import Path

    from tokenizers import Tokenizer

    own = fertility._Vocabularies(Path(fertility.VOCABULARY).read_bytes(), Path(fertility.PIECES).read_bytes())
    clean = "The quick brown fox jumps over the lazy dog while seven other animals watch it from a hill near the old river and wonder why it hurries so."
    shouted = " ".join(w.upper() + "!!" for w in clean.split())
    texts = [clean.encode(), shouted.encode(), "日本語 の 文".encode(), b""]
    found = fertility.measures(texts, ["en", "en", None, None], own, fertility.BANDS)
    bpe = Tokenizer.from_file(fertility.VOCABULARY)
    tokens = [i for w in clean.split() for i in bpe.encode(" " + w, add_special_tokens=False).ids]
    assert math.isclose(found["chars_per_token"][0], sum(map(len, clean.split())) / len(tokens))
    meet = sum(n * (n - 1) for n in Counter(tokens).values())
    assert math.isclose(found["entropy"][0], math.log2(len(tokens) * (len(tokens) - 1) / meet))
    assert list(found["kept"][:2]) == [True, False] and found["band"][2:] == ["other", "Latin"]


def test_fertility_keeps_clean_prose():
    """Formal prose and a plain list, neither in the words of the generated tables, are within the bands."""
    from pathlib import Path

    own = fertility._Vocabularies(Path(fertility.VOCABULARY).read_bytes(), Path(fertility.PIECES).read_bytes())
    formal = ("The holder of the licence shall keep the records of the sale of the goods for the term of the licence, and the holder of the records "
              "shall give the court of the district a copy of the records at the end of the term of the sale.")
    items = "Sold here: apples, pears, plums, cherries, grapes, lemons, oranges, peaches, figs, dates, melons, berries, nuts, olives, beans, peas, corn, rice, wheat, barley, oats."
    debris = " ".join(word + "*#$%"[i % 4] * 3 for i, word in enumerate(formal.split()))
    found = fertility.measures([formal.encode(), items.encode(), debris.encode()], ["en"] * 3, own, fertility.BANDS)
    assert not found["base_failed"].any()
    assert list(found["kept"]) == [True, True, False]


def test_stupid_backoff(docs, rows):
    check_backoff(docs, rows)


def check_backoff(docs, rows):
    words = [split(text) for _, text, *_ in rows]
    ones, twos = Counter(w for x in words for w in x), Counter(p for x in words for p in zip(x, x[1:], strict=False))
    expected = []
    for (key, *_), own in zip(rows, words, strict=True):
        total, backed = 0.0, 0
        for i, word in enumerate(own):
            pair = (own[i - 1], word) if i else None
            if pair and twos[pair] >= 2:
                total += math.log(twos[pair] / ones[own[i - 1]])
            else:
                backed += i > 0
                total += math.log(ones[word] / sum(ones.values()) * (0.4 if i else 1))
        expected.append((place(key), len(own), backed, round(total, 6)))
    found = lm_scores.scores(docs, block_bytes=3000).collect()
    assert sorted((place(r.id), r.n_words, r.n_backed_off, round(r.log_score, 6)) for r in found) == sorted(expected)


def test_three_words(ready):
    df = ready.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "x b c"), (4, "b d")], "doc_id long, text string")
    found = {r.id: math.exp(r.log_score) for r in lm_scores.scores(df, order=3).collect()}
    assert math.isclose(found[1], 2 / 11 * (2 / 2) * (2 / 2))
    assert math.isclose(found[3], 1 / 11 * (0.4 * 4 / 11) * (0.4 * 3 / 4))


def test_order_three_query(ready):
    """The registered query of order 3 equals its SQL."""
    from llm_rows import SF_DIR
    from oracle import duck, duck_bag

    from flotilla.llm import queries

    name = "op1_stupid_backoff_order3"
    found = queries.QUERIES[name](ready, SF_DIR)
    order = sorted(found.columns)
    names, expected = duck_bag(duck(SF_DIR), queries.ORACLES[name])
    assert order == names
    mine, theirs = (sorted((r[0], r[2], r[3], r[1]) for r in rows) for rows in ([tuple(r) for r in found.select(order).collect()], expected.elements()))
    assert [r[:3] for r in mine] == [r[:3] for r in theirs]
    assert all(math.isclose(a[3], b[3], abs_tol=2e-4) for a, b in zip(mine, theirs, strict=True))


def test_water_fill():
    assert mixing.water_fill([100, 100, 100], [1, 2, 3], 3) == [50, 100, 150]
    assert mixing.water_fill([1, 100, 100], [1, 1, 1], 3)[0] == 3
    assert mixing.water_fill([], [], 3) == [] and mixing.water_fill([0, 10], [1, 1], 3) == [0, 10]
    for sizes in ([5, 1000, 3, 40, 0, 7], [1] * 9, [10**12, 1, 1]):
        weights = [i % 3 + 1 for i in range(len(sizes))]
        found = mixing.water_fill(sizes, weights, 3)
        assert sum(found) == sum(sizes) and all(t <= 3 * s for t, s in zip(found, sizes, strict=True))
        free = [t / w for t, s, w in zip(found, sizes, weights, strict=True) if t < 3 * s]
        assert len(set(free)) <= 1


def test_mix(docs, rows):
    found = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: (place(r.doc_id), r.text or "", r.taken)
    assert sorted(map(key, found)) == sorted(map(key, again))
    names = sorted({r[3] for r in rows}, key=lambda x: (x is None, x or ""))
    sizes = {name: sum(len(split(r[1])) for r in rows if r[3] == name) for name in names}
    targets = mixing.water_fill([sizes[n] for n in names], [1, 2, 3, 1], 3)
    for name, target in zip(names, targets, strict=True):
        own = [r for r in found if r.source == name]
        assert {(r.source_size, r.target) for r in own} == {(sizes[name], float(target))}
        assert abs(sum(r.taken for r in own) - target) <= 2
    assert all(0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size + r.part_words for r in found)
    assert Counter((r.doc_id, r.size) for r in found) == Counter((r[0], len(split(r[1]))) for r in rows)
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    times = Counter(tuple(r) for r in out.collect())
    assert set(times) <= {r for r in rows if split(r[1])}  # whole rows only
    for name, target in zip(names, targets, strict=True):
        own = {r: n for r, n in times.items() if r[3] == name}
        border = max((len(split(r[1])) for r in rows if r[3] == name), default=0)
        assert abs(sum(n * len(split(r[1])) for r, n in own.items()) - target) <= border


def test_mix_of_one_id(ready):
    """Rows that share a key, or have none, are taken one by one: of equally long ones all but the one at the cut are whole."""
    rows = [(None if i % 3 else 7, f"{i} b c d", "a" if i < 90 else "b") for i in range(120)]
    docs = ready.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs).collect()
    assert sum(0 < r.part_words < r.size for r in found) <= 2
    times = Counter(r.text for r in mixing.repeated(docs).collect())
    assert set(times) <= {t for _, t, _ in rows} and max(times.values()) <= 3
    targets = mixing.water_fill([360, 120], [1, 2], 3)
    for source, target in zip("ab", targets, strict=True):
        assert abs(sum(4 * times[t] for _, t, s in rows if s == source) - target) <= 2


def test_pieces(docs, rows):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    found = pieces.decoded(pieces.encoded(docs)).collect()
    assert len(found) == len(rows) and all(r.parity for r in found)
    for r in found:
        assert r.ids == (None if r.text is None else own.encode(r.text))
        assert r.decoded == (None if r.text is None else r.text.replace("▁", " "))
        assert r.n_tokens == len(r.ids or []) and r.n_byte_tokens == sum(own.is_byte(i) for i in r.ids or [])


def test_unigram_model():
    """A small unigram model, written by hand: scores, normaliser, marker and byte fallback."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *[(f"<0x{b:02X}>", 0, 6) for b in range(256)],
                               ("▁", -3, 1), ("▁the", -2, 1), ("▁th", -4, 1), ("e", -3.5, 1), ("ab", -3, 1), ("a", -4, 1), ("b", -4.5, 1), ("▁a", -2.5, 1), ("t", -5, 1), ("h", -5, 1)]:
        model.pieces.add(piece=piece, score=score, type=kind)
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = 1, True
    model.normalizer_spec.name, model.normalizer_spec.add_dummy_prefix = "identity", True
    for extra in (False, True):
        model.normalizer_spec.remove_extra_whitespaces = extra
        data = model.SerializeToString()
        own, texts = sentencepiece.SentencePieceProcessor(model_proto=data), ["the ab", "thé  abba th", "", " a b ", "ü"]
        codec = pieces._Codec(data)
        ids, ends, same = codec.encode(texts)
        assert [list(ids[a:b]) for a, b in zip(ends, ends[1:], strict=False)] == own.encode(texts) and same.all()


def test_line_crf_chain():
    """Forward and backward sums against all labellings."""
    from itertools import product

    rnd = np.random.default_rng(1)
    ends, pairs = np.array([0, 4, 4, 5, 8]), rnd.normal(size=(2, 2))
    evidence = rnd.normal(size=8)
    good, total, expected = line_crf.chain(evidence, ends, pairs)
    seen = np.zeros((2, 2))
    for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        weights = {y: math.exp(sum(evidence[a + i] * y[i] for i in range(b - a)) + sum(pairs[y[i], y[i + 1]] for i in range(b - a - 1))) for y in product((0, 1), repeat=b - a)}
        z = sum(weights.values())
        assert b == a or math.isclose(total[k], math.log(z))
        for i in range(b - a):
            assert math.isclose(good[a + i], sum(w for y, w in weights.items() if y[i]) / z)
        for y, w in weights.items():
            for i in range(b - a - 1):
                seen[y[i], y[i + 1]] += w / z
    assert np.allclose(seen, expected)


def test_line_crf(ready, docs, rows):
    good, bad = "These are quiet words that say something.\n" * 3, "BUY!! NOW!! *** $$$\nBUY!! NOW!! ###\n" * 3
    known = ready.createDataFrame([(i, good + f"text {i} ends." if i % 2 else bad + f"{i} !!") for i in range(200)], "doc_id long, text string")
    labels = ready.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (3, None), (5000, 1)], "doc_id long, quality int")
    model = line_crf.train(known, labels.where(~line_crf.held_out(F.col("doc_id"))))
    found = line_crf.scored(known, model).withColumn("held_out", line_crf.held_out(F.col("doc_id"))).where("held_out").collect()
    assert len(found) > 20 and all(r.predicted == r.doc_id % 2 for r in found)
    odd = line_crf.scored(docs, model).collect()
    assert len(odd) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in odd)
    assert {r.score for r in odd if not split(r.text)} == {model.prior}
    assert line_crf.scored(known, line_crf.train(known, labels.limit(0))).where("score between 0.4 and 0.6").count() == 200


def test_no_rows(no_docs, ready):
    model = line_crf.Model(np.zeros(line_crf.WIDTH), np.zeros((2, 2)), 0.5, np.zeros(line_crf.WIDTH), np.ones(line_crf.WIDTH))
    for result in (phrase_dedup.remove_repeats(no_docs), suffix_dedup.remove_repeats(no_docs), minhash.near_duplicates(no_docs), minhash.drop_near_duplicates(no_docs),
                   fertility.judged(no_docs), lm_scores.scores(no_docs), mixing.mix(no_docs), mixing.repeated(no_docs), pieces.decoded(pieces.encoded(no_docs)), line_crf.scored(no_docs, model)):
        assert result.collect() == []


def test_workers_that_forget(monkeypatch, rows):
    """Dropping remembered words changes nothing."""
    from pathlib import Path

    import sentencepiece

    monkeypatch.setattr(pieces, "REMEMBERED", 60)
    monkeypatch.setattr(fertility, "REMEMBERED", 60)
    texts = [r[1] for r in rows if r[1]]
    model = Path(pieces.MODEL).read_bytes()
    codec, own = pieces._Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    files = Path(fertility.VOCABULARY).read_bytes(), Path(fertility.PIECES).read_bytes()
    worker = fertility._Vocabularies(*files)
    for text in texts[:40]:
        ids, ends, same = codec.encode([text, text])
        assert [list(ids[a:b]) for a, b in zip(ends, ends[1:], strict=False)] == own.encode([text, text]) and same.all()
        found = fertility.measures([text.encode()], [None], worker, fertility.BANDS)
        fresh = fertility.measures([text.encode()], [None], fertility._Vocabularies(*files), fertility.BANDS) if len(text) < 300 else found
        assert all(np.array_equal(found[name], fresh[name]) for name in found)
    assert len(codec.known) < 500


def test_sorted_keys_travel_as_gaps():
    from flotilla.llm.blocks import packed, unpacked

    rnd = np.random.default_rng(4)
    for keys in ([0], [2**64 - 1], [0, 2**64 - 1], [5, 6, 7], rnd.integers(0, 2**64, 5000, dtype=np.uint64), rnd.integers(0, 2**40, 300)):
        keys = np.unique(np.array(keys, np.uint64))
        assert np.array_equal(unpacked(packed(keys)), keys)


def test_workers_keep_the_tables_of_one_operator():
    """A worker serves every stage of the pipeline: what one stage remembers must not stay beside the next one's memory."""
    from pathlib import Path

    import pyarrow as pa

    model = Path(pieces.MODEL).read_bytes()
    codec = pieces._codec(model)
    assert pieces._codec(bytes(bytearray(model))) is codec
    words = fertility._vocabularies(Path(fertility.VOCABULARY).read_bytes(), model)
    assert list(tables._HELD.values()) == [words]
    list(minhash._sets(iter([])))
    assert not tables._HELD
    pieces._codec(model)
    phrase_dedup._Block(pa.table({"id": pa.array([1]), "text": ["a b"], "block": [0]}), 20, 6)
    assert not tables._HELD


def test_words_encoded_in_a_row():
    """Words that are encoded as one text have the tokens that each has alone, in few calls, and on one thread in a worker."""
    import random
    from pathlib import Path

    rnd = random.Random(8)
    odd = ["x\u00a0", "\u00a0x", "\u3000", "\x85", "a\u2028b", "'s", "'", "<|endoftext|>", "\x1c", "\0", "Ġ", "ĠĠa", "▁", "▁▁", "a▁", "▁a", "日本", "😀", "é", "e\u0301", "1234567", "\ufffd", "<0x41>", "<unk>", "</s>"]
    words = [*dict.fromkeys(odd + ["".join(rnd.choice("aeinrst'.#é日9") for _ in range(rnd.randint(1, 30))) for _ in range(700)] + [a + b for a in odd for b in odd if len(a + b) < 4])]
    rnd.shuffle(words)
    model = Path(pieces.MODEL).read_bytes()
    own = fertility._Vocabularies(Path(fertility.VOCABULARY).read_bytes(), model)
    codec = pieces._Codec(model)
    texts: list[int] = []

    class Counting:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, batch, **kw):
            texts.append(len(batch))
            return self.tokenizer.encode_batch_fast(batch, **kw)

    alone = [own.bpe.encode(" " + w, add_special_tokens=False).ids for w in words]
    own.bpe = Counting(own.bpe)
    at = own.look_up([w.encode() for w in words])
    starts = np.cumsum(own.sizes) - own.sizes
    assert [own.tokens[starts[i]:starts[i] + own.sizes[i]].tolist() for i in at] == alone
    assert [own.n_pieces[i] for i in at] == [len(own.pieces.encode(w)) for w in words]
    marked = ["▁" + w for w in words] + ["▁▁▁", "▁▁", "▁"]
    alone = [codec.words.encode(w, add_special_tokens=False).ids for w in marked]
    codec.words = Counting(codec.words)
    at = codec._look_up(marked)
    starts = np.cumsum(codec.sizes) - codec.sizes
    assert [codec.ids[starts[i]:starts[i] + codec.sizes[i]].tolist() for i in at] == alone
    assert codec.agrees[at][[i for i, w in enumerate(marked) if "▁" not in w[1:]]].all()
    assert max(texts) < len(words) / 3
    assert tables.FRUGAL["TOKENIZERS_PARALLELISM"] == "false"


def test_parity_is_told_word_by_word():
    from pathlib import Path

    codec = pieces._Codec(Path(pieces.MODEL).read_bytes())
    words = ["▁the", "▁quick", "▁brown", "▁"]
    sizes, ids = codec._ids(words[:3], words[3:])
    assert codec._parity(words, sizes, ids).all()
    ids[sizes[0]] += 1
    assert codec._parity(words, sizes, ids).tolist() == [True, False, True, True]
    assert codec._parity(words[::-1], sizes, ids).tolist() == [a == b for a, b in zip(words, words[::-1], strict=True)]


def test_stretches_are_hashed_in_small_pieces(monkeypatch):
    """Arrays of one piece stay below 256 KB, and how texts fall into pieces changes nothing."""
    import random

    import pyarrow as pa

    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abc ") for _ in range(rnd.choice([0, 150, 199, 200, 201, 900, 4000]))) for _ in range(150)] + [None, "x" * 60_000]
    group = pa.table({"text": pa.array(texts, pa.string())})
    longest, hashed = [], suffix_dedup.stretches
    monkeypatch.setattr(suffix_dedup, "stretches", lambda data, *rest: longest.append(len(data)) or hashed(data, *rest))
    small = suffix_dedup._Block(group, 200, 64)
    assert 8 * max(n for n in longest if n != 60_000) <= 256 << 10
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 1 << 19)
    large = suffix_dedup._Block(group, 200, 64)
    assert len(small.all.anchor) and all(np.array_equal(getattr(small.all, x), getattr(large.all, x)) for x in ("anchor", "content", "places", "first", "last"))


def test_anchors_spread_over_buckets():
    """A least hash is close to zero: sent as it is, one bucket would merge most of the corpus."""
    import random

    import pyarrow as pa

    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(400)]
    own = suffix_dedup._Block(pa.table({"text": [" ".join(rnd.choice(words) for _ in range(400)) for _ in range(200)]}), 200, 64)
    for buckets in (8, 51):
        filled = np.bincount(blocks.bucket_of(own.keys, buckets), minlength=buckets)
        assert filled.sum() > 4000 and filled.max() < 2 * filled.mean()


def test_buckets_grow_with_the_text(ready, docs, rows, monkeypatch):
    """What one bucket merges is bounded by bytes of text, not by the number of shuffle partitions alone."""
    total = sum(len((r[1] or "").encode()) for r in rows)
    assert blocks.measured_blocks(docs, "doc_id", "text")[1] == total
    parts = tables.shuffle_partitions(ready)
    assert blocks.buckets_for(ready, total) == parts
    monkeypatch.setattr(blocks, "BUCKET_BYTES", math.ceil(total / (3 * parts)))
    assert blocks.buckets_for(ready, total) > 2 * parts
    sent, asked = [], blocks.buckets_for
    monkeypatch.setattr(blocks, "buckets_for", lambda *args: sent.append(asked(*args)) or sent[-1])
    check_byte_strings(docs, rows)
    assert sent[0] > 2 * parts


def test_one_tokenizer_a_worker(monkeypatch):
    from pathlib import Path

    made, build = [], pieces.rebuilt
    monkeypatch.setattr(pieces, "rebuilt", lambda model: made.append(model) or build(model))
    codec = pieces._Codec(Path(pieces.MODEL).read_bytes())
    codec.encode(["some words", ""])
    assert len(made) == 1


def test_worker_settings_hold_for_what_is_made_inside(ready):
    import os

    import pyarrow as pa

    def told(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([os.environ["MALLOC_MMAP_THRESHOLD_"]] * len(batch))], ["v"])

    seen = lambda df: df.mapInArrow(told, "v string")
    one = ready.createDataFrame([("",)], "v string")
    before = dict(ready.sparkContext.environment)
    with tables.workers_with(ready, tables.KEEPING):
        inside = seen(one)
    assert ready.sparkContext.environment == before
    assert [inside.first()[0], seen(one).first()[0]] == [tables.KEEPING["MALLOC_MMAP_THRESHOLD_"], tables.FRUGAL["MALLOC_MMAP_THRESHOLD_"]]
