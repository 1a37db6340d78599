import duckdb
import pytest

from flowledger.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    got = queries.queries()[name](spark, DATA).toArrow()
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name]).to_arrow_table()
    columns = sorted(got.column_names)
    rows = lambda t: sorted(map(repr, zip(*[t.column(c).to_pylist() for c in columns], strict=True)))
    assert columns == sorted(want.column_names) and rows(got) == rows(want)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    kept = {r.doc_id: r.text for r in docs.collect()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {p.doc_id for p in pieces} == set(kept) and 0.5 * before < len(kept) <= before
    assert corpus_pipeline.run(spark, DATA).count() == len(pieces)


def test_pipeline_keeps_one_of_a_large_group_of_copies(spark, documents):
    import corpus_pipeline

    copy = "first line of a copied page with words\n\n\nsecond line of it with other words"
    docs = documents([copy] * 4 + [f"menu\nown words number {i} of page {i * i} and {i + 7}" for i in range(36)]).select("doc_id", "text", "lang", "source", "n_chars")
    found = corpus_pipeline.line_dedup(spark, docs, DATA)
    texts = {r.doc_id: r.text for r in found.collect()}
    assert [texts[i] for i in range(4)] == [copy] * 4 and all("menu" not in texts[i] for i in range(4, 40))
    assert [r.doc_id for r in corpus_pipeline.ngram_jaccard(spark, found, DATA).where("doc_id < 4").collect()] == [0]


def test_pipeline_drops_lines_of_small_sources(spark, documents):
    import corpus_pipeline

    docs = documents([f"menu\nown words number {i} of page {i * i}" for i in range(19)] + ["menu\nalone"], sources=["small"] * 19 + ["one"]).select("doc_id", "text", "lang", "source", "n_chars")
    small = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, DATA).collect()}
    assert all("menu" not in small[i] and "own" in small[i] for i in range(19)) and small[19] == "menu\nalone"


@pytest.mark.parametrize("langs", [["en"] * 40 + [None] * 5, [None] * 45])
def test_pipeline_keeps_every_text_with_a_letter(spark, documents, langs):
    import corpus_pipeline

    texts = [f"plain words of a text, number {i}" for i in range(40)] + ["Все счастливые семьи", "日本語のテキスト", "Ω", "12 345 ...", None]
    docs = documents(texts, langs=langs).select("doc_id", "text", "lang", "source", "n_chars")
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, DATA).collect()) == list(range(43))


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_lines(rows):
    """Texts without the lines on two pages or more and on over 5 % of their source's."""
    pages, total = {}, {}
    for _, text, _, source, _ in rows:
        total[source] = total.get(source, 0) + 1
        for line in set((text or "").split("\n")):
            pages[source, line] = pages.get((source, line), 0) + 1
    out = {}
    for i, text, _, source, _ in rows:
        left = None if text is None else "\n".join(x for x in text.split("\n") if not x.strip(" ") or pages[source, x] < 2 or pages[source, x] <= 0.05 * total[source])
        out[i] = text if text and not (left or "").replace("\n", " ").strip(" ") and left != text else left
    return out


def plain_groups(texts):
    """The smallest id of each document's group of linked shingle sets."""
    import re

    sets = {}
    for i, t in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    group = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]) and group[a] > group[b]:
                    group[a], changed = group[b], True
    return group


def plain_cuts(texts, length=100):
    """Texts without the bytes of strings that start earlier, and without parts of characters; those of which nothing is left go."""
    seen, out = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                gone[k : k + length] = [True] * length
            seen.add(b[k : k + length])
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode(errors="ignore")
        if not any(gone):
            out[i] = texts[i]
        elif left.strip(" "):
            out[i] = left
    return out


def test_each_stage_equals_brute_force(spark, documents):
    import random

    import corpus_pipeline

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 6))) for _ in range(200)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    texts = []
    for i in range(90):
        if i % 6 == 5:
            near = rng.choice(texts).split(" ")
            near[rng.randrange(len(near))] = rng.choice(words)
            texts.append(" ".join(near))
        else:
            texts.append("menu line\n" + " ".join(rng.choice(words) for _ in range(rng.choice([2, 30, 60]))) + (" " + passage if i % 9 == 0 else ""))
    texts += [None, "", " ", "12 34 !", texts[3], texts[3]]
    docs = documents(texts, sources=["ab"[i % 2] for i in range(len(texts))]).select(*COLUMNS)
    held = lambda df: {r.doc_id: r.text for r in df.collect()}
    kept = corpus_pipeline.language_id(spark, docs, DATA).persist()
    assert held(kept) == {i: t for i, t in enumerate(texts) if any(c.isalpha() for c in t or "")}
    cleaned = corpus_pipeline.line_dedup(spark, kept, DATA).persist()
    assert held(cleaned) == plain_lines([tuple(r) for r in kept.collect()])
    single = corpus_pipeline.ngram_jaccard(spark, cleaned, DATA).persist()
    groups = plain_groups(held(cleaned))
    assert held(single) == {i: t for i, t in held(cleaned).items() if groups[i] == i} and len(held(single)) < len(groups)
    rest = corpus_pipeline.suffix_dedup(spark, single, DATA).persist()
    assert held(rest) == plain_cuts(held(single)) and held(rest) != held(single)
    assert all(df.columns == COLUMNS and df.where("n_chars <> length(text)").count() == 0 for df in (kept, cleaned, single, rest))


def test_stages_of_odd_tables(spark, documents):
    import corpus_pipeline

    odd = documents([None, "", "a b", "a b", "x", "Word " * 300], ids=[1, 2, 3, 3, None, None], langs=[None, "en", None, "en", None, "en"], sources=[None, "s", None, "s", "s", None])
    wide = odd.withColumn("c0", odd["text"]).withColumn("gone", odd["text"]).withColumn("whole", odd["text"]).withColumn("k", odd["doc_id"])
    for docs in (odd.limit(0), wide):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, DATA).persist()
            assert docs.columns == COLUMNS, name
        pieces = corpus_pipeline.packed(spark, docs, DATA).collect()
        assert sorted({str(p.doc_id) for p in pieces}) == sorted({str(r.doc_id) for r in docs.collect()})
    assert {r.doc_id for r in docs.collect()} == {3, None}
