import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowledger.llm import common, jaccard, langid, lines, lm, packing, pieces, suffix, tokens

ODD = [None, "", " ", "\n", "a", "Ab cd", "Ω ß İ <|endoftext|> a▁b  c", "日本語 テキスト", "x" * 3000, "  lead and trail  ", "a\tb\x0bc\r\nd", "🙂 ok", "é H̱", "one two three four five", "ONE two three four five", "one two three four"]


def sample(seed=0, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.15:
            out.append(rng.choice(out))
        elif out and kind < 0.45:
            near = rng.choice(out).split(" ")
            for _ in range(rng.randint(1, 3)):
                near[rng.randrange(len(near))] = rng.choice(words)
            out.append(" ".join(near))
        else:
            out.append(" ".join(rng.choice(words) for _ in range(rng.choice([3, 8, 40, 120]))))
    passage = " ".join(rng.choice(words) for _ in range(60))
    return [t + "\n" + passage if i % 7 == 0 else t for i, t in enumerate(out)]


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x20\x09-\x0d]+", low)


# --- word hashes and components


def test_word_hashes_agree_with_words():
    texts = [t or "" for t in ODD] + sample(3)
    column = __import__("pyarrow").array(texts)
    raw, offsets = common.text_buffer(column)
    hashes, at = common.word_hashes(raw, offsets)
    seen = {}
    for i, t in enumerate(texts):
        own = words_of(t)
        assert len(own) == at[i + 1] - at[i]
        for w, h in zip(own, hashes[at[i] : at[i + 1]].tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (4, 9), (9, 8), (7, 7), (10, 11), (11, 10)]
    got = {(r.node, r.component) for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (8, 4), (9, 4), (10, 10), (11, 10)}
    chain = [(i, i + 1) for i in range(60)]
    assert {r.component for r in common.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()} == {0}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- tokens and pieces


def test_word_encoder_equals_library(tokenizer):
    coder = tokens.encoder(tokenizer("word_bpe_49k.json"))
    texts = [t or "" for t in ODD] + sample(4) + ["don't we'LL <|startoftext|>X", "1½²", "…!?,.", "naïve CAFÉ."]
    for t, got in zip(texts, coder.encode_texts(texts), strict=True):
        assert got.tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_length_histogram(spark, documents, tokenizer):
    texts = ODD + sample(5)
    coder = tokens.encoder(tokenizer("word_bpe_49k.json"))
    n = Counter(len(i) + 1 for i in coder.encode_texts(texts))
    sums = tokens.length_histogram(documents(texts), tokenizer("word_bpe_49k.json"), end_ids=1)
    want = {(k, n[k], sum(v for x, v in n.items() if x >= k), sum(v * x for x, v in n.items() if x >= k), sum(v for x, v in n.items() if x <= k), sum(v * min(x, k) for x, v in n.items())) for k in n}
    assert {tuple(r) for r in sums.collect()} == want
    assert {tuple(r) for r in tokens.truncated_totals(sums, [1, 7, 5000]).collect()} == {(c, sum(v * min(x, c) for x, v in n.items())) for c in (1, 7, 5000)}
    every = sorted(n.elements())
    assert tokens.length_quantile(sums, 0.5) == every[-(-len(every) // 2) - 1]
    assert tokens.length_histogram(documents(texts).limit(0), tokenizer("word_bpe_49k.json")).count() == 0


def test_suffix_sums_over_ranges(spark):
    hist = spark.createDataFrame([(5, 2), (1500, 1), (9000, 3)], "length long, n_docs long")
    assert {(r.length, r.docs_at_least, r.tokens_at_least, r.docs_at_most) for r in tokens.suffix_sums(hist).collect()} == {(5, 6, 28510, 2), (1500, 4, 28500, 3), (9000, 3, 27000, 6)}


def test_pieces_equal_library(tokenizer):
    coder = pieces.encoder(tokenizer("piece_bpe_32k.model"))
    rng = random.Random(6)
    parts = [" ", "  ", "▁", "a", "the", "é", "日", "\n", "🙂", "\x00", "in", "aaaa", "     ", "==", "́", "--", "0", ".", ","]
    texts = [t or "" for t in ODD] + sample(6) + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(2000)]
    for t in texts:
        ids = np.frombuffer(coder.encode(t), "<u4")
        assert ids.tolist() == coder.library.encode(t), t
    prefix = coder.prefix_table("▁unbelievable")
    assert coder.names[prefix[-1]] == coder.library.encode("unbelievable", out_type=str)[-1]


def test_piece_round_trip(documents, tokenizer):
    model = tokenizer("piece_bpe_32k.model")
    texts = ODD + sample(7)
    lib = pieces.encoder(model).library
    got = {r.doc_id: r for r in pieces.round_trip_digests(documents(texts), model).collect()}
    for i, t in enumerate(texts):
        ids = [1, *lib.encode(t or ""), 2]
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want
    coded = pieces.encode_pieces(documents(texts), model)
    back = {r.doc_id: r.text for r in pieces.decode_pieces(coded, model).collect()}
    assert back == {i: lib.decode([1, *lib.encode(t or ""), 2]) for i, t in enumerate(texts)}
    assert pieces.round_trip_digests(documents(texts).limit(0), model).count() == 0


# --- language ID


def test_language_id(documents):
    rng = random.Random(8)
    parts = {"aa": ["the", "and", "ing", "of"], "bb": ["que", "los", "ción", "ñ"]}
    texts, langs = [], []
    for i in range(120):
        lang = "aa" if i % 3 else "bb"
        texts.append(" ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 80))))
        langs.append(lang)
    model = langid.fit(documents(texts[:60], langs=langs[:60]))
    got = {r.doc_id: r for r in langid.annotate(documents(texts, langs=langs), model).collect()}
    assert sum(got[i].lang_pred == langs[i] for i in range(60, 120)) >= 58
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = [r.lang_pred for r in langid.predict(documents([None, "", " 12 !", "1a", "the"]), model).orderBy("doc_id").collect()]
    assert odd[:3] == ["und"] * 3 and "und" not in odd[3:]
    nothing = langid.fit(documents(["x"], langs=[None]))
    assert [r.lang_pred for r in langid.predict(documents(["the"]), nothing).collect()] == ["und"]
    assert langid.predict(documents(texts).limit(0), model).count() == 0


def test_code_lengths_equal_a_plain_model():
    texts = {"a": [b"abracadabra", b"aab"], "b": [b"banana band", b"nab"]}
    model = langid.fit_texts(texts, order=3)

    def bits(lang, before, symbol):
        for k in range(min(3, len(before)), -1, -1):
            ctx = before[len(before) - k :]
            n = Counter(t[i + k] for t in [b"\n" + x for x in texts[lang]] for i in range(len(t) - k) if t[i : i + k] == ctx)
            total, distinct = sum(n.values()), len(n)
            if not total:
                continue
            if symbol in n:
                return -np.log2(n[symbol] / (total + distinct))
            yield_up = -np.log2(distinct / (total + distinct))
            return yield_up + (bits_at(lang, before, symbol, k - 1))
        return 8.0

    def bits_at(lang, before, symbol, k):
        if k < 0:
            return 8.0
        return bits(lang, before[len(before) - k :] if k else b"", symbol)

    asked = [b"banana", b"abzab", b"", b"nabracad", b"q"]
    raw, offsets = np.frombuffer(b"".join(asked), np.uint8), np.append(0, np.cumsum([len(x) for x in asked]))
    got = langid.text_bits(model, raw, offsets)
    for i, t in enumerate(asked):
        full = b"\n" + t
        for j, lang in enumerate(model.languages):
            assert got[i, j] == pytest.approx(sum(bits(lang, full[max(0, p - 3) : p], full[p]) for p in range(1, len(full))), abs=1e-3)


# --- lines


@pytest.mark.parametrize("most", [0, 500_000])
def test_line_dedup(documents, monkeypatch, most):
    monkeypatch.setattr(lines, "BROADCAST_LINES", most)
    texts = [f"menu\nown {i}\n\nmenu" for i in range(30)] + ["menu\nsmall host", None, "", "menu", "solo"]
    sources = ["big"] * 30 + ["small"] * 1 + ["big"] * 3 + [None]
    got = {r.doc_id: (r.text, r.lines_dropped) for r in lines.drop_boilerplate(documents(texts, sources=sources)).collect()}
    assert got[0] == ("own 0\n", 2) and got[30] == ("menu\nsmall host", 0) and got[31] == (None, 0) and got[32] == ("", 0) and got[33] == ("", 1) and got[34] == ("solo", 0)
    assert lines.drop_boilerplate(documents(texts).limit(0)).count() == 0


# --- Jaccard join


def brute_components(texts, ids):
    sets = []
    for t in texts:
        w = words_of(t)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    out = {}
    links = {i: {j for j in range(len(sets)) if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])} for i in range(len(sets))}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[ids[i]] = (len(sets[i]), min(ids[j] for j in seen))
    return out


@pytest.mark.parametrize("cell,hot", [(256, 64), (4, 2)])
def test_jaccard_components(documents, monkeypatch, cell, hot):
    monkeypatch.setattr(jaccard, "CELL_SETS", cell)
    monkeypatch.setattr(jaccard, "HOT_IN_SLICE", hot)
    texts = ODD + sample(9, 150) + sample(9, 150)[:40]
    ids = [3 * i + 1 for i in range(len(texts))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(documents(texts, ids).repartition(3)).collect()}
    assert got == brute_components(texts, ids)
    assert jaccard.jaccard_components(documents(texts).limit(0)).count() == 0


@pytest.mark.parametrize("told", [0, 1000])
def test_jaccard_components_over_many_buckets(documents, monkeypatch, told):
    monkeypatch.setattr(jaccard, "BUCKET_BYTES", 64)
    monkeypatch.setattr(jaccard, "SLICE_BYTES", 2048)
    monkeypatch.setattr(jaccard, "COPIED_SETS", told)
    texts = ODD + sample(9, 150) + sample(9, 150)[:40] + [sample(9, 150)[3]] * 30
    ids = [None if i % 50 == 9 else 3 * (i % 170) for i in range(len(texts))]
    got = sorted((r.n_shingles, r.component_id is None) for r in jaccard.jaccard_components(documents(texts, ids).repartition(3)).collect())
    monkeypatch.undo()
    want = sorted((r.n_shingles, r.component_id is None) for r in jaccard.jaccard_components(documents(texts, ids).repartition(3)).collect())
    assert got == want
    ids = list(range(len(texts)))
    monkeypatch.setattr(jaccard, "BUCKET_BYTES", 64)
    monkeypatch.setattr(jaccard, "SLICE_BYTES", 2048)
    monkeypatch.setattr(jaccard, "COPIED_SETS", told)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(documents(texts, ids).repartition(3)).collect()}
    assert got == brute_components(texts, ids)


def test_jaccard_sends_no_more_for_more_buckets(documents, monkeypatch):
    """Sets' keys and sizes went along with each bucket's shingles, so that what was shuffled grew with documents times buckets."""
    rng = random.Random(4)
    docs = documents([" ".join(str(rng.randrange(10**6)) for _ in range(10)) for _ in range(6000)]).coalesce(1)
    monkeypatch.setattr(jaccard, "BUCKET_BYTES", 6000)
    sent, real = [], type(docs).mapInArrow

    def kept(df, f, schema, *rest, **options):
        found = real(df, f, schema, *rest, **options)
        return sent.append(found) or found if "bucket" in found.columns else found

    monkeypatch.setattr(type(docs), "mapInArrow", kept)
    assert jaccard.jaccard_components(docs).count() == 6000
    (rows,) = sent
    assert rows.where("bucket >= 0").select("bucket").distinct().count() > 60
    size = sum(F.octet_length(c) for c, kind in rows.dtypes if kind == "binary")
    assert rows.agg(F.sum(size)).first()[0] < 16 * 6000 * 6


# --- suffix arrays


def brute_repeats(texts, length):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = True
            seen.add(b[i : i + length])
        out.append((b, gone))
    return out


def test_suffix_array_by_induction():
    rng = random.Random(10)
    for _ in range(300):
        s = bytes(rng.choice(b"abc" if rng.random() < 0.5 else b"ab cdefgh\xe9") for _ in range(rng.randint(1, 60))) * rng.randint(1, 4)
        text = np.append(np.frombuffer(s, np.uint8), np.uint8(0))
        assert suffix.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tobytes())


@pytest.mark.parametrize("words", [1, 4, 1024])
def test_permuted_common_prefixes(monkeypatch, words):
    monkeypatch.setattr(suffix, "_MOST_WORDS", words)
    rng = random.Random(20)
    for _ in range(200):
        s = bytes(rng.choice(b"ab" if rng.random() < 0.5 else b"ab cdefgh\xe9") for _ in range(rng.randint(1, 40))) * rng.randint(1, 5)
        text = np.append(np.frombuffer(s, np.uint8), np.uint8(0))
        order = suffix.suffix_array(text)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tobytes())
        want = np.zeros(len(text), int)
        for a, b in zip(order[:-1].tolist(), order[1:].tolist()):
            while s[a + want[b] : a + want[b] + 1] == s[b + want[b] : b + want[b] + 1] != b"":
                want[b] += 1
        assert suffix.common_prefixes(text, order).tolist() == want.tolist()


@pytest.mark.parametrize("hot,length", [(500, 100), (1, 100), (500, 24), (1, 24)])
def test_repeats_match_brute_force(documents, monkeypatch, hot, length):
    monkeypatch.setattr(suffix, "HOT_STRETCHES", hot)
    monkeypatch.setattr(suffix, "CHUNK_BYTES", 2000)
    texts = ODD + sample(11) + ["ab" * 400, "xyz " * 200 + "é" * 90, "é" * 120]
    rows = suffix.remove_repeats(documents(texts), length).collect()
    assert {r.f for r in rows} == {"x"} and len(rows) == len(texts)
    want = brute_repeats(texts, length)
    for r in rows:
        b, gone = want[r.doc_id]
        assert bytes(r.kept_bytes) == np.frombuffer(b, np.uint8)[~gone].tobytes(), r.doc_id
        mask = np.zeros(len(b), bool)
        for s in r.removed_spans:
            mask[s.start : s.end] = True
        assert (mask == gone).all() and len(r.removed_spans) == int((np.diff(np.append(0, gone.astype(int))) == 1).sum())


def test_repeats_of_equal_ids_and_none(documents):
    rng = random.Random(15)
    text = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = suffix.remove_repeats(documents([text, text, text], ids=[5, 5, None]), as_text=True).collect()
    assert sorted(len(r.kept_text) for r in rows) == [0, 0, len(text)]
    assert suffix.remove_repeats(documents([text]).limit(0)).count() == 0


# --- packing


def test_packing_keeps_every_id(documents, tokenizer):
    path = tokenizer("word_bpe_49k.json")
    texts = ODD + sample(12) + ["word " * 5000]
    coder = tokens.encoder(path)
    ids = [np.append(i, 1) for i in coder.encode_texts(texts)]
    rows = packing.pack(documents(texts), path, window=256).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for d, own in enumerate(ids):
        got = sorted(by_doc[d], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in got) == own.astype("<u4").tobytes() and {r.doc_tokens for r in got} == {len(own)}
        assert all(r.start == sum(x.length for x in got[:i]) for i, r in enumerate(got))
    for own in by_seq.values():
        own = sorted(own, key=lambda r: r.offset)
        assert all(r.offset == sum(x.length for x in own[:i]) for i, r in enumerate(own))
    full = [sum(r.length for r in s) for s in by_seq.values()]
    assert max(full) <= 256 and sum(n < 256 for n in full) <= 1
    assert packing.pack(documents(texts).limit(0), path).count() == 0


def test_packing_brings_neighbours_together():
    rng = np.random.default_rng(13)
    topics = [rng.integers(100 * t, 100 * t + 40, size=(30, 50)) for t in range(4)]
    ids = [topics[i % 4][i // 4].astype(np.uint32) for i in range(120)]
    found = packing.pack_shard(ids, 200)
    together = Counter()
    by_seq = {}
    for d, _, _, s, _ in found:
        by_seq.setdefault(s, set()).add(d % 4)
    together.update(len(x) for x in by_seq.values())
    assert together[1] > 0.8 * len(by_seq)


def test_packing_scores_all_shared_terms():
    # Item 0 and items 1 to 40 share 40 rare terms, one each; item 41 shares the 60 common ones with it.
    rare, often = np.arange(40), np.arange(100, 160)
    items = [np.append(rare, often)] + [np.array([r, 200 + r]) for r in rare] + [often] + [np.append(often[i::2], 300 + i) for i in (0, 1)]
    items = [i.astype(np.uint32) for i in items]
    index, used = packing.Bm25(items), np.zeros(len(items), bool)
    used[0] = True
    n, mean = len(items), sum(map(len, items)) / len(items)
    df = Counter(t for i in items for t in set(i.tolist()))
    idf = {t: math.log1p((n - k + 0.5) / (k + 0.5)) for t, k in df.items()}
    score = {k: sum(idf[t] * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(i) / mean)) for t in set(i.tolist()) & set(items[0].tolist())) for k, i in enumerate(items) if k}
    found = index.neighbours(items[0], used)
    assert found[0] == 41 and len(found) == 43 and [score[k] for k in found] == pytest.approx(sorted(score.values(), reverse=True))


def test_packing_places_by_content_with_statistics_of_all(documents, tokenizer):
    path, rng = tokenizer("word_bpe_49k.json"), random.Random(5)
    topics = [["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(12)] for _ in range(6)]
    texts = [" ".join(rng.choice(topics[i % 6]) for _ in range(60)) for i in range(240)]
    rows = packing.pack(documents(texts), path, window=512, shard_bytes=sum(map(len, texts)) // 6).collect()
    shards, by_seq = {}, {}
    for r in rows:
        shards.setdefault(r.sequence_id >> 32, set()).add(r.doc_id)
        by_seq.setdefault(r.sequence_id, set()).add(r.doc_id % 6)
    assert len(shards) >= 6 and set().union(*shards.values()) == set(range(240)) and sum(map(len, shards.values())) == 240
    assert sum(len(s) == 1 for s in by_seq.values()) > 0.6 * len(by_seq)
    ids = [np.append(i, 1).astype(np.uint32) for i in tokens.encoder(path).encode_texts(texts)]
    coded = documents(texts).sparkSession.createDataFrame([(i.astype("<u2").tobytes(),) for i in ids], "ids binary")
    got, want = packing.statistics_of(coded, 512, "<u2"), packing.Statistics.of([i[len(i) - len(i) % 512 :] for i in ids])
    assert got.n == want.n == 240 and got.mean == want.mean and (got.df == want.df).all()


def test_neighbours_equal_plain_bm25():
    rng = np.random.default_rng(21)
    items = [rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint32) for _ in range(90)] + [np.array([3, 3, 7], np.uint32)] * 3
    n, mean = len(items), sum(map(len, items)) / len(items)
    df = Counter(t for i in items for t in set(i.tolist()))
    index = packing.Bm25(items)

    def weight(term, item):
        count = Counter(item.tolist())[term]
        idf = math.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5))
        return idf * count * (packing.K1 + 1) / (count + packing.K1 * (1 - packing.B + packing.B * len(item) / mean))

    for q in (0, 17, 91):
        used = np.zeros(n, bool)
        used[[q, 5, 30]] = True
        score = {i: sum(weight(t, items[i]) for t in set(items[q].tolist())) for i in range(n) if not used[i]}
        best = sorted((i for i in score if score[i] > 0), key=lambda i: -score[i])[: packing.NEIGHBOURS]
        got = index.neighbours(items[q], used)
        assert [score[i] for i in got] == pytest.approx([score[i] for i in best], rel=1e-5) and len(got) == len(set(got)) and not set(got) & {q, 5, 30}
        assert all(a < b for a, b in zip(got, got[1:]) if score[a] == score[b] and items[a].tolist() == items[b].tolist())


def test_packing_splits_a_hot_group(documents, tokenizer):
    texts = ["the same words in every copy of it"] * 300
    rows = packing.pack(documents(texts), tokenizer("word_bpe_49k.json"), window=64, shard_bytes=2000).collect()
    sizes = Counter(shard for shard, _ in {(r.sequence_id >> 32, r.doc_id) for r in rows})
    assert sum(sizes.values()) == 300 and max(sizes.values()) < 120


# --- language model


def plain_model(train):
    bigrams = Counter()
    for t in train:
        w = ["<s>", *words_of(t), "</s>"]
        bigrams.update(zip(w, w[1:]))
    count, after, before, kinds = Counter(), Counter(), Counter(), {}
    for (v, w), n in bigrams.items():
        count[w] += n
        after[v] += n
        before[w] += 1
        kinds.setdefault(v, Counter())[min(n, 3)] += 1
    types = len(bigrams)
    of = lambda c: [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
    d, e = lm._discounts(*of(bigrams)), lm._discounts(*of(before))
    vocabulary = len(count)
    gamma = sum(e[min(n, 3) - 1] for n in before.values()) / types

    def prob(v, w):
        low = (max(before[w] - e[min(before[w], 3) - 1], 0) if before[w] else 0) / types + gamma / (vocabulary + 1)
        if not after[v]:
            return low
        own = bigrams[v, w]
        return ((own - d[min(own, 3) - 1]) if own else 0) / after[v] + sum(d[k - 1] * n for k, n in kinds[v].items()) / after[v] * low

    return prob, count, vocabulary


def test_language_model_equals_plain_counting(documents, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_BYTES", 500)
    texts = sample(14, 80) + ODD
    train = [t for i, t in enumerate(texts) if i % 4]
    docs = documents(texts)
    model = lm.fit(docs.where("doc_id % 4 <> 0"))
    prob, count, vocabulary = plain_model(train)
    total = sum(count.values())
    assert (model.train_tokens, model.vocabulary) == (total, vocabulary) and model.bits > 2
    for r in lm.score(docs, model).collect():
        w = ["<s>", *words_of(texts[r.doc_id]), "</s>"]
        assert r.n_tokens == len(w) - 1 and r.n_known == sum(count[x] > 0 for x in w[1:])
        assert r.base_score == pytest.approx(sum(np.log10((count[x] + 0.5) / (total + 0.5 * (vocabulary + 1))) for x in w[1:]))
        assert r.score == pytest.approx(sum(np.log10(prob(a, b)) for a, b in zip(w, w[1:])), rel=1e-9)
    # Of a seen and an unseen history the words' probabilities sum to one, with one unseen word.
    for v in ("<s>", "never seen"):
        assert sum(prob(v, w) for w in [*count, "no such word"]) == pytest.approx(1)


def test_language_model_of_nothing(documents):
    model = lm.fit(documents(["a"]).limit(0))
    rows = lm.score(documents([None, "a b"]), model).collect()
    assert [r.n_tokens for r in rows] == [1, 3] and all(np.isfinite(r.score) for r in rows)
    assert lm.score(documents(["a"]).limit(0), model).count() == 0


def test_remainder_is_the_ids_crc(documents):
    got = {r.doc_id: r.m for r in documents(["a"] * 20).select("doc_id", common.id_remainder("doc_id", 5).alias("m")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 for i in range(20)}


# --- cases of one id, clashing names, long texts and lost files


def test_language_sample_is_bounded(spark, documents):
    texts = [f"text number {i} of the label" for i in range(3000)]
    one_id = langid.fit(documents(texts, ids=[7] * 3000), sample_docs=5)
    alone = langid.fit(documents([min(texts)]), sample_docs=5)
    assert one_id.languages == ["en"] and all((a == b).all() for a, b in zip(one_id.costs, alone.costs, strict=True))
    long = langid.fit(documents(["aaaa " * 4000] + ["bb cc"] * 10), sample_bytes=2000)  # the long text is in no one's way
    assert not (long.grams[0].find(np.array([256 + ord("a")], np.uint64)) >= 0).any()
    assert (langid.fit(documents(["aaaa " * 4000]), sample_bytes=2000).grams[0].find(np.array([256 + ord("a")], np.uint64)) >= 0).all()


@pytest.mark.parametrize("most", [0, 500_000])
def test_line_dedup_names_and_repeated_rows(spark, most):
    names = ["doc_id", "text", "source", "h", "listed", "row", "salt", "lines_dropped", "c0", "__host"]
    rows = [(1 if i < 10 else i, f"menu\nown {i % 5}", "s", *["kept"] * 7) for i in range(30)] + [(None, "menu", None, *["kept"] * 7)]
    got = lines.drop_boilerplate(spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names)), broadcast_lines=most)
    assert sorted(got.columns) == sorted(names)
    found = [(r.doc_id, r.text, r.source, r.h, r["__host"], r.lines_dropped) for r in got.collect()]
    want = [(r[0], "", "s", "kept", "kept", 2) for r in rows[:30]] + [(None, "menu", None, "kept", "kept", 0)]
    assert sorted(map(repr, found)) == sorted(map(repr, want))


def test_a_lost_model_file_is_an_error(spark, documents, tmp_path):
    import dataclasses
    import os
    import shutil

    texts = ["a b c", "b c d", "c d e " * 20]
    model = lm.fit(documents(texts))
    copy = dataclasses.replace(model, folder=str(tmp_path / "model"))  # no worker has it open
    shutil.copytree(model.folder.removeprefix("file:"), copy.folder)
    assert lm.score(documents(texts), model).count() == 3
    os.remove(sorted(str(f) for f in (tmp_path / "model").glob("words*"))[0])
    with pytest.raises(Exception, match="No such file|not find"):
        lm.score(documents(texts), copy).collect()
    lm.delete(copy)
    assert not os.path.exists(copy.folder) and lm.score(documents(texts), model).count() == 3


def test_long_texts_cross_slices(documents, tokenizer, monkeypatch):
    long = " ".join(sample(11, 40))
    texts = [long, "short one", None, long + " more"]
    for module, name in ((tokens, "SLICE_BYTES"), (lm, "SLICE_BYTES"), (jaccard, "SLICE_BYTES"), (langid, "SLICE")):
        monkeypatch.setattr(module, name, 1 << 9)
    coder = tokens.WordEncoder(tokenizer("word_bpe_49k.json"), cache_words=40)
    want = [coder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [i.tolist() for i in coder.encode_texts(texts)] == want and len(coder.keys) < 2000
    raw, offsets = common.text_buffer(__import__("pyarrow").array(texts))
    items, ends = jaccard.shingle_sets(raw, offsets, 5)
    whole = words_of(long)
    assert ends[1] == len({tuple(whole[i : i + 5]) for i in range(len(whole) - 4)})


def test_suffix_arrays_of_long_runs():
    rng = np.random.default_rng(3)
    for t in range(300):
        x = np.repeat(rng.integers(1, 4, rng.integers(1, 20)), rng.integers(1, 60)).astype(np.uint8)
        text = np.append(x, 0).astype(np.uint8)
        whole = text.tobytes()
        assert suffix.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: whole[i:])
    one = np.append(np.full(1 << 20, 9), 0).astype(np.uint8)
    assert (suffix.suffix_array(one) == np.arange(1 << 20, -1, -1)).all()
    assert suffix.later_windows([b"a" * 5000], 100) == [(0, 1, 5000)]


def test_many_empty_and_short_texts_are_packed_in_bounded_shards(spark, tokenizer):
    docs = spark.range(40000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, "").otherwise("a").alias("text"))
    found = packing.pack(docs, tokenizer("word_bpe_49k.json"))
    assert found.select("doc_id").distinct().count() == 40000
    shards = found.groupBy(F.shiftright("sequence_id", 32).alias("s")).agg(F.count_distinct("doc_id").alias("n")).collect()
    assert len(shards) > 1 and max(r.n for r in shards) <= 2 * (6 << 20) // packing.LEAST_SIZE


def test_no_model_folder_is_left(spark, tmp_path, documents):
    from flowledger.llm import queries

    documents(["a b c", "b c d e", "c d"]).write.parquet(f"{tmp_path}/documents.parquet")
    before = {p.rsplit("/", 1)[-1] for p in _folders(spark)}
    assert queries.op10_lm_scoring(spark, str(tmp_path)).count() == 3
    assert not [p for p in {x.rsplit("/", 1)[-1] for x in _folders(spark)} - before if "model" in p]


def _folders(spark):
    import glob

    return glob.glob(f"{common.checkpoint_dir(spark).removeprefix('file:')}/*")


def plain_pack(ids, window):
    """Windows filled by the rule: a seed, its unused neighbours by BM25 (ties: earlier), then those of the last one placed, then the next in order."""
    rest = {d: x[len(x) - len(x) % window :] for d, x in enumerate(ids) if len(x) % window}
    n, mean = len(rest), sum(map(len, rest.values())) / max(len(rest), 1)
    df = Counter(t for x in rest.values() for t in set(x.tolist()))

    def score(a, b):
        both = sorted(set(rest[a].tolist()) & set(rest[b].tolist()))
        weight = lambda t: math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * (c := int((rest[b] == t).sum())) * (packing.K1 + 1) / (c + packing.K1 * (1 - packing.B + packing.B * len(rest[b]) / mean))
        return sum(weight(t) for t in both)

    pieces = [(d, k * window, window) for d, x in enumerate(ids) for k in range(len(x) // window)]
    left, at, used, cut = {d: len(x) for d, x in rest.items()}, {d: len(ids[d]) - len(x) for d, x in rest.items()}, set(), None
    near = lambda d: sorted((b for b in rest if b not in used and score(d, b) > 0), key=lambda b: (-round(score(d, b), 9), b))
    unused = lambda: next((d for d in rest if d not in used), None)
    while (now := unused() if cut is None else cut) is not None:
        room, queue, cut = window, None, None
        while now is not None:
            used.add(now)
            take = min(room, left[now])
            pieces.append((now, at[now], take))
            room, left[now], at[now] = room - take, left[now] - take, at[now] + take
            if left[now]:
                cut = now
            if not room:
                break
            queue = near(now) if queue is None else queue
            queue = [d for d in queue if d not in used] or near(now)
            now = queue.pop(0) if queue else unused()
    return pieces


def test_packing_equals_a_plain_greedy_packer():
    rng = np.random.default_rng(11)
    for trial in range(25):
        ids = [np.minimum(rng.zipf(1.6, rng.integers(0, 60)), 40).astype(np.uint16) for _ in range(45)]
        ids += [ids[3], ids[3].copy(), ids[7], np.full(70, 2, np.uint16), np.zeros(0, np.uint16)]
        ids = [np.append(x, 1).astype(np.uint16) for x in ids]
        got = packing.pack_shard(ids, 32)
        assert [p[:3] for p in got] == plain_pack(ids, 32), trial
