import hashlib
import math
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from flowledger.llm import dialogue, quality, ranked

# --- ranked search


def terms_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def plain_ranking(docs, items, k=10):
    """Each item's best documents by the score's definition, over all pairs."""
    own = {row: (i, terms_of(t)) for row, (i, t) in enumerate(docs) if terms_of(t)}
    n_docs, length = len(own), sum(len(t) for _, t in own.values())
    df = {}
    for _, t in own.values():
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for doc_id, t in own.values():
            m = 25 + (75 * len(t) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * t.count(x)) // (1000 * t.count(x) + 8 * m)) for x in terms_of(text) if x in df)
            scores += [(-score, doc_id is None, doc_id, score)] if score > 0 else []
        out += [(item, r + 1, doc_id, score) for r, (_, _, doc_id, score) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def prose(rng, n, words=60):
    vocabulary = ["".join(rng.choice("abcdeé1") for _ in range(rng.randint(1, 4))) for _ in range(words)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 5, 30, 90]))) for _ in range(n)]


@pytest.mark.parametrize("block_terms", [ranked.BLOCK_TERMS, 40])
def test_ranked_search_equals_all_pairs(spark, monkeypatch, block_terms):
    monkeypatch.setattr(ranked, "SHARD_POSTINGS", 500)
    rng = random.Random(3)
    texts = prose(rng, 80)
    texts += [None, "", "...", "Ab-ab ÀB x", "a" * 5000, *texts[:6], *texts[:3]]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4]), (None, "zz " + texts[5])]
    items = [(7, texts[3]), (8, "a b c d e"), (8, texts[10] + " " + texts[10]), (9, None), (10, "???"), (11, "nowhere"), (None, "ab a"), (7, texts[3])]
    wide = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], "doc_id long, text string, n int, item int, terms string")
    asked = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted([tuple(r) for r in ranked.search(wide, asked, block_terms=block_terms).collect()], key=str)
    assert got == plain_ranking(docs, items)


def test_ranked_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.search(docs.limit(0), items).count() == 0 and ranked.search(docs, items.limit(0)).count() == 0
    assert ranked.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_best_positions_stop_early_and_keep_ties():
    rng = np.random.default_rng(1)
    for trial in range(40):
        n_docs, n_terms = 3000, 6
        own = [rng.choice(n_docs, size=rng.integers(0, 2000), replace=False) for _ in range(n_terms)]
        terms, docs = np.repeat(np.arange(n_terms), [len(x) for x in own]), np.concatenate(own).astype(np.int64)
        impacts = rng.integers(0, 6 if trial % 2 else 10**6, len(docs)) ** (1 if trial % 2 else 2)
        shard = ranked.Shard(terms, docs, impacts, n_docs, n_terms)
        asked, times = np.arange(n_terms), rng.integers(1, 4, n_terms)
        want = np.zeros(n_docs, np.int64)
        np.add.at(want, docs, impacts * times[terms])
        order = [d for d in np.lexsort((np.arange(n_docs), -want))[:10] if want[d] > 0]
        for _ in range(2):  # marks are cleared between searches
            found, scores, read = shard.search(asked, times, 10)
            assert found.tolist() == order and scores.tolist() == want[order].tolist() and read <= len(docs)
    lists = [np.arange(5000), np.arange(5000)]
    shard = ranked.Shard(np.repeat([0, 1], 5000), np.concatenate(lists), np.tile(np.arange(5000, 0, -1), 2), 5000, 2)
    assert shard.search(np.array([0, 1]), np.array([1, 1]), 10)[2] <= 64  # of 10,000 places


def test_positions_seen_by_direct_access_count():
    """The second list's first documents are met by direct access from the first, so its best position passes what was read of it."""
    terms = np.repeat([0, 1], [600, 2000])
    docs = np.concatenate([np.arange(600), np.arange(2000)])
    impacts = np.concatenate([np.full(600, 10**6), np.where(np.arange(2000) < 600, 1000, 1)])
    shard = ranked.Shard(terms, docs, impacts, 2000, 2)
    found, scores, read = shard.search(np.array([0, 1]), np.array([1, 1]), 10)
    assert found.tolist() == list(range(10)) and set(scores.tolist()) == {1_001_000} and read < 2600


# --- conversation repair

ROLES = ["system", "user", "assistant", "tool", "", "User"]
TEXTS = ["", " \t", "Yes.", "No", "Well?  ", "ok!\n", "so, then", "a", "b.", "Ünï。", None, "line\nbreak."]


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        role, text = "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    return {c: sorted(rows, key=order) for c, rows in out.items()}


def plain_repair(rows):
    """Least (cost, audit) over all edits, by recursion over rows and states; and the row's digests."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    nxt = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @lru_cache(None)
    def best(i, q, inserts=0):
        options = [(0, "", ())] if i == len(rows) and q in (0, 3) else []
        for letter, role in (("u", "user"), ("a", "assistant")):
            if (q, letter) in nxt and inserts < 3:
                c, a, lines = best(i, nxt[q, letter], inserts + 1)
                options.append((c + 5, "I" + a, (role + ":", *lines)))
        if i < len(rows):
            _, own, text = rows[i]
            c, a, lines = best(i + 1, q)
            options.append((c + 2, "D" + a, lines))
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 * (faults[i] == "truncated")
                for role, edit, cost in ((own, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                    if (q, role[:1]) in nxt:
                        c, a, lines = best(i + 1, nxt[q, role[:1]])
                        options.append((c + cost + extra, edit + a, (f"{role}:{text}", *lines)))
        return min(options, default=(10**9, "", ()))

    for i in range(len(rows), 0, -10):
        for q in range(4):
            best(i, q)
    cost, audit, lines = best(0, 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *[faults.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(rng, n):
    rows = []
    for conv in range(n):
        for turn in range(rng.choice([1, 2, 3, 6, 9])):
            rows += [(conv, rng.choice([turn, turn, turn, turn + 2, None]), rng.choice(ROLES[:3] if rng.random() < 0.8 else ROLES), rng.choice(TEXTS))] * rng.choice([1, 1, 1, 1, 3])
    return rows


def test_repair_equals_all_edits(spark):
    rng = random.Random(8)
    rows = conversations(rng, 150) + [(None, t, rng.choice(ROLES), rng.choice(TEXTS)) for t in (None, 0, 1, 2, 5)] + [(5, 1, None, None), (400, 7, "user", "only")]
    rows += [(c, 0, "user", "Hello.") for c in range(500, 540)]
    wide = spark.createDataFrame([(*r, 1, "x", b"y") for r in rows], "conv_id long, turn long, role string, text string, n int, c string, digest binary")
    got = {r.conv_id: tuple(r)[1:] for r in dialogue.repair(wide).collect()}
    want = {c: plain_repair(tuple(r)) for c, r in damaged(rows).items()}
    assert got == want and any(not r for r in damaged(rows).values())


def test_repair_of_a_conversation_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(dialogue, "RANGE_BYTES", 2000)
    rng = random.Random(4)
    rows = [(1, rng.randrange(400), rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice([*TEXTS, f"text {k}.", f"cut {k}"])) for k in range(700)]
    rows += [(1, 3, "user", "same text.")] * 300 + conversations(rng, 20)
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    assert dialogue.pieces(docs).where("conv_id = 1").count() > 5
    got = {r.conv_id: tuple(r)[1:] for r in dialogue.repair(docs).collect()}
    want = {c: plain_repair(tuple(r)) for c, r in damaged(rows).items()}
    assert got == want
    texts = dialogue.repaired_texts(docs).where("conv_id = 1 and lines > 0").orderBy("part").collect()
    assert hashlib.sha256("\n".join(r.body for r in texts).encode()).hexdigest() == want[1][-1]


def test_block_tables_equal_single_steps():
    rng, one, many = random.Random(2), dialogue.Tables(1), dialogue.Tables(3)
    assert one.vectors == many.vectors and len(one.vectors) < 2000
    for _ in range(200):
        symbols = "".join(rng.choice(dialogue.SYMBOLS) for _ in range(rng.randrange(30)))
        end = rng.randrange(len(one.vectors))
        assert one.before(symbols, end)[1] == many.before(symbols, end)[1] and one.before(symbols, end)[0][0] == many.before(symbols, end)[0][0]
        assert all(one.trace(symbols, q, 0) == many.trace(symbols, q, 0) for q in range(4))
        assert one.matrix(symbols) == many.matrix(symbols)


def test_repair_of_an_empty_table(spark):
    assert dialogue.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- quality rules


def plain_statistics(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def test_text_statistics_equal_plain_counts(spark):
    rng = random.Random(6)
    texts = [None, "", " ", "a", "a b c", "a a a a", "a b c a b c", "\x0b a\x0cb \r\n\n a\x0cb ", "🙂 é|# <x> 100%\n🙂 é|# <x> 100%\n\n", "x " * 400, "    a"]
    texts += ["\n".join(" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "l", "s", 9, "w") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_words int, words string")
    got = {r.doc_id: tuple(r)[3:] for r in quality.text_statistics(docs).collect()}
    assert got == {i: plain_statistics(t) for i, t in enumerate(texts)}


def made(rng, n, symbols=0.0, length=5.0):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(max(1, int(rng.gauss(length, 1.5))))) + ("$" if rng.random() < symbols else "") for _ in range(n))


def test_outliers_are_rejected_by_group(spark):
    rng = random.Random(1)
    rows = [(i, made(rng, rng.randint(60, 200)), "en", "a") for i in range(160)] + [(200 + i, made(rng, 90, symbols=0.95, length=9), "en", "a") for i in range(30)]
    rows += [(300 + i, made(rng, 90, length=9), "de", "b") for i in range(120)] + [(500 + i, made(rng, 80), "en", "few") for i in range(5)] + [(600, made(rng, 80, symbols=0.95, length=9), "en", "few")]
    rows += [(700, made(rng, 80), None, None), (701, None, "en", "a"), (702, "", None, "a"), (703, "few words", "en", "a"), (704, "one two three " * 40, "en", "a")] + [(705, rows[0][1], "en", "a")] * 3
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, lang string, source string, x0 int, level int, m int")
    got = quality.judge(docs).collect()
    kept = {r.doc_id: r.kept for r in got}
    assert len(got) == len(rows) and [r.level for r in got if r.doc_id in (0, 300, 500, 700)] == [0, 0, 1, 2]
    assert not any(kept[200 + i] for i in range(30)) and not kept[600]  # a sixth of the group doesn't hide itself
    assert all(kept[i] for i in [*range(160), *range(300, 420), *range(500, 505), 700, 705])
    assert all(r.base_failed and not r.kept for r in got if r.doc_id in (701, 702, 703, 704))
    assert quality.judge(docs.limit(0)).count() == 0 and quality.judge(docs.where("doc_id = 1")).first().kept


def plain_determinants(x, starts, rng):
    """Log determinants that concentration steps reach from random starts of P + 1 vectors."""
    h, floors, best = math.ceil(quality.SHARE * len(x)), np.diag([(f * quality.STEPS) ** 2 for f in quality.FLOORS]), math.inf
    scatter = lambda s: quality.CONSISTENCY * np.cov(s.T, bias=True) + floors
    for _ in range(starts):
        subset = x[rng.choice(len(x), quality.P + 1, replace=False)]
        for _ in range(30):
            u = x - subset.mean(0)
            subset = x[np.argsort(np.einsum("ij,jk,ik->i", u, np.linalg.inv(scatter(subset)), u), kind="stable")[:h]]
        best = min(best, np.linalg.slogdet(scatter(subset))[1])
    return best


def test_estimates_reach_the_least_determinant_of_many_starts(spark):
    rng = np.random.default_rng(5)
    mixed = rng.normal(size=(240, quality.P)) @ np.array([[60, 20, 0, 5], [0, 80, 10, 0], [0, 0, 50, 30], [0, 0, 0, 70]]) + 300
    mixed[:50] += [900, -400, 300, 800]
    x = np.rint(mixed).astype(int)
    rows = spark.createDataFrame([("l", "s", *map(int, v)) for v in x], "lang string, source string, x0 long, x1 long, x2 long, x3 long")
    found = quality.estimates(rows).where("level = 0").first()
    assert found.texts == 240 and found.logdet <= plain_determinants(x.astype(float), 60, rng) + 0.05
    precision = np.zeros((quality.P, quality.P))
    for i, j in quality.PAIRS:
        precision[i, j] = precision[j, i] = found[f"p{i}{j}"]
    assert abs(-np.linalg.slogdet(precision)[1] - found.logdet) < 1e-6
    u = x - np.array([found[f"m{i}"] for i in range(quality.P)])
    far = np.einsum("ij,jk,ik->i", u, precision, u) > quality.quantile(1 - quality.ALPHA)
    assert far[:50].all() and not far[50:].any()


def test_main_path_has_no_python_workers(spark, capsys):
    docs = spark.createDataFrame([(1, "a b", "en", "s")], "doc_id long, text string, lang string, source string")
    quality.text_statistics(docs).explain()
    quality.judge(docs).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_chi_squared_values():
    assert abs(quality.quantile(0.95) - 9.4877) < 1e-3 and abs(quality.quantile(0.95, 6) - 12.5916) < 1e-3
