"""Operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from tests.llm.helpers import frame, prose, words
from texelmill.llm import chat, fingerprints, langid, lines, mixing, ngram_join, pages, substrings, topk
from texelmill.llm.components import components

# ---- mixing ------------------------------------------------------------------------------------------------------------


def expected_targets(sizes: dict, weights=(5, 2, 1), share=1.5):
    """Resharing round by round, as the words say it."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    cap, fixed, total = {s: 2.0 * sizes[s] for s in names}, {}, share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        got = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if got[s] > cap[s]]
        if not over:
            return fixed | got
        fixed |= {s: cap[s] for s in over}


def test_mixing_meets_targets(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.choice([0, 1, 3, 20, 20, 200])) for _ in range(600)] + [None, "", " \t", "x " * 5000]
    docs = frame(spark, texts, sources=("s1", "s1", "s1", "s1", "s2", "s10", None, "é"))
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(texts)
    sizes: dict = defaultdict(int)
    for r in rows:
        assert r.size == len(words(texts[r.doc_id]))
        sizes[r.source] += r.size
    want = expected_targets(sizes)
    taken = Counter()
    for r in rows:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(20, 0.01 * t)
    again = {(r.doc_id, r.taken) for r in mixing.mix_sources(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def test_mixing_tilts_exponentially(spark):
    rng = random.Random(4)
    docs = frame(spark, [prose(rng, rng.randrange(1, 60)) for _ in range(400)], sources=("a", "b", "c"))
    by = defaultdict(dict)
    for r in mixing.mix_sources(docs).collect():
        by[r.source][r.size] = r.rate
    import math

    for rates in by.values():
        free = {s: math.log(r) / s for s, r in rates.items() if r < 2 and s}
        assert not free or max(free.values()) - min(free.values()) < 1e-9


def test_mixing_of_nothing(spark):
    assert mixing.mix_sources(frame(spark, ["a"]).limit(0)).count() == 0
    assert [r.taken for r in mixing.mix_sources(frame(spark, [None, ""])).collect()] == [0, 0]


# ---- line dedup --------------------------------------------------------------------------------------------------------


def test_wide_lines(spark):
    same = "All rights reserved."
    texts = [f"own {i}\n  {same} \n\nlast {i % 2}" for i in range(12)] + [None, "", same, "few\nfew"]
    docs = frame(spark, texts, sources=tuple(f"s{i}" for i in range(12)))
    got = {r.doc_id: r for r in lines.remove_wide_lines(docs, min_sites=10).collect()}
    assert got[0].text == texts[0] and got[0].n_removed == 0  # the first keeps it
    assert all(got[i].text == f"own {i}\n\nlast {i % 2}" and got[i].n_removed == 1 for i in range(1, 12))
    assert got[12].text is None and got[12].n_lines == 0
    assert got[13].text == "" and got[14].text == "" and got[14].n_removed == 1 and got[15].text == "few\nfew"
    assert lines.remove_wide_lines(docs.limit(0)).count() == 0
    assert [r.n_removed for r in lines.remove_wide_lines(docs, min_sites=13).collect()] == [0] * len(texts)


def test_lines_near_the_threshold_are_counted_exactly(spark):
    rows = [(i, f"line of {n} sites", f"s{i}") for n in (18, 19, 20, 21, 22, 60) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").groupBy("doc_id", "source").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    wide = lines.wide_lines(lines.distinct_lines(docs), 20)
    assert wide.count() == 4


# ---- n-gram join -------------------------------------------------------------------------------------------------------


def expected_components(texts: dict):
    sets = {}
    for d, t in texts.items():
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(texts)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in texts}


def test_ngram_join(spark):
    rng = random.Random(8)
    texts = [None, "", " \n", "One two", "one TWO", "two one", "É e f g h", "é e f g h"]
    passage = prose(rng, 60)
    for _ in range(25):
        base = prose(rng, rng.choice([6, 12, 40, 150, 400])).split()
        for _ in range(rng.choice([1, 2, 4, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += [prose(rng, n) + " " + passage for n in (0, 5, 10, 14, 15, 16, 30, 60, 60, 60, 100, 200)]
    rng.shuffle(texts)
    want = expected_components(dict(enumerate(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(frame(spark, texts)).collect()}
    assert got == want
    assert any(d != c for d, (_, c) in want.items())


def test_ngram_signatures_meet_for_every_linked_pair():
    """All shingles frequent, some or none: linked sets that differ share a signature."""
    import numpy as np

    rng = np.random.default_rng(2)
    for trial in range(400):
        n = int(rng.integers(1, 200))
        shared = rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
        cut = int(rng.integers(0, n // 9 + 2))
        a = np.unique(np.concatenate([shared, rng.integers(0, 2**63, int(rng.integers(0, cut + 1)), dtype=np.int64).astype(np.uint64)]))
        b = np.unique(np.concatenate([shared[cut:], rng.integers(0, 2**63, int(rng.integers(0, cut + 1)), dtype=np.int64).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if not len(b) or len(a) == len(b) == both or 100 * both < 80 * (len(a) + len(b) - both):
            continue
        every = np.union1d(a, b)
        frequent = np.sort(rng.choice(every, int(len(every) * rng.choice([0, 0.3, 0.9, 1])), replace=False))
        assert len(np.intersect1d(ngram_join.signatures(a, frequent), ngram_join.signatures(b, frequent))), (trial, len(a), len(b), both)


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(50)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ngram_join_of_nothing_and_repeated_rows(spark):
    assert ngram_join.similar_groups(frame(spark, ["a"]).limit(0)).count() == 0
    docs = frame(spark, ["a b c d e f g"] * 3).withColumn("doc_id", F.lit(4).cast("long"))
    assert [tuple(r) for r in ngram_join.similar_groups(docs).collect()] == [(4, 3, 4)] * 3


def test_ngram_join_of_rows_without_id(spark):
    """Near copies without an id belong to their component and bridge it."""
    rng = random.Random(11)
    word = lambda: f"n{rng.randrange(10**9)}"
    base = [word() for _ in range(200)]
    near = lambda n: " ".join([*base[: 200 - n], *(word() for _ in range(n))])
    other = [word() for _ in range(200)]
    shifted = lambda i: " ".join(other[i : i + 150])  # noqa: E731  neighbours by 15 link, by 30 do not
    lone = [word() for _ in range(50)]
    rows = [(5, " ".join(base)), (None, near(8)), (None, near(9)), (None, near(9)), (1, shifted(0)), (None, shifted(15)), (9, shifted(30)), (None, " ".join(lone)), (None, " ".join(lone[:-2])), (None, None), (None, ""), (5, shifted(0))]
    texts = dict(enumerate(t for _, t in rows))
    want = expected_components(texts)
    ids = defaultdict(list)
    for k, (_, c) in want.items():
        ids[c] += [rows[k][0]] if rows[k][0] is not None else []
    expected = Counter((rows[k][0], n, min(ids[c], default=None)) for k, (n, c) in want.items())
    assert expected[None, 146, 1] == 1 and want[4][1] == want[6][1]
    assert Counter(tuple(r) for r in ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == expected


# ---- top-k -------------------------------------------------------------------------------------------------------------


def test_top_k(spark):
    import math

    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(9)]) for i in range(700)]
    rows += [(1000 + i, rows[50][1]) for i in range(20)]  # ties
    rows += [(2000, None), (2050, [0.1, None] + [0.0] * 7), (2100, [float("nan")] * 9), (2150, [float("inf")] * 9), (None, [1.0] * 9), (2200, []), (2250, [0.5, -0.5])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    plain = {r.vec_id: [math.floor(256 * float(x)) for x in r.embedding] for r in vectors.collect() if r.vec_id is not None and r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(vectors.where("vec_id % 50 = 0"), vectors, 5).collect()}
    want = {}
    for q in (q for q in plain if q % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(plain[q], v)), i) for i, v in plain.items() if i != q)[:5]
        want |= {(q, k): (i, -s) for k, (s, i) in enumerate(scored, 1)}
    assert got == want
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0
    assert topk.top_k(vectors.where("vec_id = 50"), vectors.where("vec_id in (50, 51)")).count() == 1


def test_blocks_are_left_out():
    import numpy as np

    ids = np.arange(640)
    matrix = np.repeat(np.eye(10, dtype=np.int64) * 100, 64, axis=0)
    seen = []
    best = topk.Best(np.array([-1]), matrix[:1], 5)
    real = topk._scores
    topk._scores = lambda q, d: seen.append(len(d)) or real(q, d)
    try:
        best.visit(topk.Blocks(ids, matrix))
    finally:
        topk._scores = real
    assert seen == [10, 64] and best.who[0].tolist() == [0, 1, 2, 3, 4]  # the bounds, then one block


def test_each_query_has_its_own_order_and_keeps_its_scores(monkeypatch):
    import numpy as np

    # 10 blocks of one direction each; query i wants block i alone
    matrix = np.repeat(np.eye(10, dtype=np.int64) * 100, 64, axis=0)
    seen = []
    real = topk._scores
    monkeypatch.setattr(topk, "_scores", lambda q, d: seen.append((len(q), len(d))) or real(q, d))
    best = topk.Best(-np.arange(1, 11), np.eye(10, dtype=np.int64) * 100, 5)
    best.visit(topk.Blocks(np.arange(640), matrix))
    assert seen == [(10, 10)] + [(1, 64)] * 10
    assert best.who.tolist() == [[64 * i + j for j in range(5)] for i in range(10)]
    # what a second chunk may add is below the kth score: bounds only
    seen.clear()
    best.visit(topk.Blocks(np.arange(640, 1280), matrix // 2))
    assert seen == [(10, 10)]


def test_several_chunks_and_groups(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(topk, "CHUNK_BLOCKS", 2)
    monkeypatch.setattr(topk, "GROUP", 8)
    rng = np.random.default_rng(4)
    matrix = rng.integers(-40, 40, (900, 6)) / 16
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "vec_id long, embedding array<double>")
    whole = np.floor(matrix * 256).astype(np.int64)
    want = set()
    for q in range(0, 900, 30):
        scores = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(900), -scores)) if i != q][:5]
        want |= {(q, rank + 1, int(i), int(scores[i])) for rank, i in enumerate(order)}
    for cell in (16, 2):
        monkeypatch.setattr(topk, "CELL", cell)
        assert {tuple(r) for r in topk.top_k(rows.where("vec_id % 30 = 0"), rows).collect()} == want


# ---- language ----------------------------------------------------------------------------------------------------------


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    rows = langid.identify(docs.where(out), langid.fit(docs.where(~out))).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows) > 0
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.rejected for r in rows) <= 0.01 * len(rows)


def plain_kneser_ney(text_grams: Counter):
    """Interpolated Kneser-Ney by definition, over tuples of ORDER characters: a function of (context, character)."""
    levels = {langid.ORDER: text_grams}
    for k in range(langid.ORDER - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    alphabet = len(levels[1]) + 1

    def discount(k: int) -> float:
        once, twice = (sum(n == i for n in levels[k].values()) for i in (1, 2))
        return once / (once + 2 * twice) if once else 0.5

    def probability(context: tuple, c: int) -> float:
        k = len(context) + 1
        lower = probability(context[1:], c) if context else 1 / alphabet
        after = {g: n for g, n in levels[k].items() if g[:-1] == context}
        if not after:
            return lower
        d = discount(k)
        return (max(after.get((*context, c), 0) - d, 0) + d * len(after) * lower) / sum(after.values())

    return probability


def test_language_model_by_brute_force():
    import itertools
    import math

    import numpy as np

    rng = random.Random(6)
    for size, letters in ((0, "abcd"), (30, "ab"), (400, "abcd")):
        text = [ord(c) for c in "abcda" + "".join(rng.choices(letters, [2**-i for i in range(len(letters))], k=size))]
        grams = Counter(tuple(text[i : i + langid.ORDER]) for i in range(len(text) - langid.ORDER + 1))
        plain = plain_kneser_ney(grams)
        model = langid.KneserNey.fit(np.array(list(grams), np.uint32), np.array(list(grams.values())))
        every = list(itertools.product(map(ord, "abcd?"), repeat=langid.ORDER))
        got = model.score([np.array(c, np.uint32) for c in zip(*every)])
        assert all(math.isclose(p, math.log(plain(g[:-1], g[-1])), rel_tol=1e-9, abs_tol=1e-9) for g, p in zip(every, got))
        # an unseen character has what is left: known ones and one unseen make a distribution
        known = {g[-1] for g in grams}
        for context in itertools.product(map(ord, "abcd?"), repeat=langid.ORDER - 1):
            assert math.isclose(sum(plain(context, c) for c in [*known, ord("?")]), 1.0, abs_tol=1e-9)


def test_predictions_by_brute_force(spark):
    """Least mean of the log probabilities, gram by gram, on whole texts of the given table."""
    import numpy as np
    import pyarrow as pa

    from texelmill.llm import words as buffers

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = langid.fit(docs)
    rows = langid.identify(docs, found).collect()
    assert len(found.langs) > 1
    for row in rows[:: max(1, len(rows) // 5)]:
        data, at = buffers.text_buffer(pa.array([row.text or ""], pa.string()))
        chars, _ = langid.letters(data, at)
        n = len(chars) - langid.ORDER + 1
        if row.lang_pred == "und":
            continue
        means = []
        for model in found.models:
            logs = [model.score([chars[i + j : i + j + 1] for j in range(langid.ORDER)])[0] for i in range(n)]
            means.append(-sum(logs) / n)
        assert found.langs[int(np.argmin(means))] == row.lang_pred and abs(min(means) - row.cross_entropy) < 1e-9


def test_language_of_odd_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.fit(docs)
    odd = frame(spark, [None, "", "123 !?", "ж" * 3000, "the of and " * 20000, "\x00é"])
    got = {r.doc_id: r for r in langid.identify(odd, found).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and all(got[i].rejected and got[i].score == 0 for i in range(3))
    assert got[3].rejected and got[4].lang_pred == "en" and not got[4].rejected
    nothing = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}
    assert langid.identify(odd.limit(0), found).count() == 0


def test_language_rejects_what_no_language_fits(spark):
    """A few rows under a wrong label or of random letters don't loosen the limit; given documents stay."""
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    english = [r.text for r in docs.where("lang = 'en' and length(text) > 500").orderBy("doc_id").limit(10).collect()]
    wrong = [(None, t, lang) for t in english for lang in ("de", "fr", "es")] + [(None, noise(600), "de") for _ in range(3)] + [(None, noise(600), "en") for _ in range(10)]
    found = langid.fit(docs.union(spark.createDataFrame(wrong, docs.schema)))
    foreign = [
        "Съешь же ещё этих мягких французских булок да выпей чаю ", "Zażółć gęślą jaźń chrząszcz brzmi w trzcinie w Szczebrzeszynie wszystkie drzewa rosną nad rzeką ",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ",
    ]
    odd = [noise(n) for n in (100, 400, 2000, 20000) for _ in range(5)] + [(t * 30)[:n] for t in foreign for n in (100, 400, 2000)]
    got = langid.identify(frame(spark, odd), found).collect()
    assert [r.text for r in got if not r.rejected] == []
    rows = langid.identify(docs, found).collect()
    assert sum(r.rejected for r in rows) <= 0.002 * len(rows)


def test_language_sample_takes_a_text_once(spark):
    rng = random.Random(6)
    texts = [prose(rng, 20) for _ in range(60)]
    docs = frame(spark, texts[:1] * 500 + texts, langs=("en",)).union(frame(spark, texts[:5], langs=("de",)))
    got = Counter((r.lang, r.text) for r in langid.sample(docs, most=50).collect())
    assert max(got.values()) == 1 and Counter(lang for lang, _ in got) == {"en": 50, "de": 5}
    assert Counter((r.lang, r.text) for r in langid.sample(docs, most=1000).collect()) == Counter({("en", t): 1 for t in texts} | {("de", t): 1 for t in texts[:5]})


def test_kneser_ney_sums_to_one():
    import numpy as np

    rng = np.random.default_rng(0)
    text = rng.choice([97, 98, 99, 32], 4000)
    grams, counts = np.unique(np.lib.stride_tricks.sliding_window_view(text, langid.ORDER), axis=0, return_counts=True)
    model = langid.KneserNey.fit(grams.astype(np.uint32), counts)
    alphabet = np.unique(text)
    for row in grams[:50]:
        columns = [np.full(len(alphabet), c, np.uint32) for c in row[:-1]] + [alphabet.astype(np.uint32)]
        total = np.exp(model.score(columns)).sum()
        assert 0.75 < total <= 1.0001  # one share of the alphabet is kept for characters never seen


# ---- substrings --------------------------------------------------------------------------------------------------------


def expected_kept(texts: dict, size: int = 50):
    first: dict = {}
    w = {d: words(t) for d, t in texts.items()}
    for d in sorted(texts):
        for i in range(len(w[d]) - size + 1):
            first.setdefault(tuple(w[d][i : i + size]), d)
    out = {}
    for d in texts:
        gone = set()
        for i in range(len(w[d]) - size + 1):
            if first[tuple(w[d][i : i + size])] < d:
                gone.update(range(i, i + size))
        out[d] = (" ".join(x for i, x in enumerate(w[d]) if i not in gone), len(w[d]), len(gone))
    return out


def test_substrings(spark):
    rng = random.Random(9)
    passage, other = prose(rng, 70), prose(rng, 49)
    texts = [None, "", prose(rng, 49), prose(rng, 50), "a " * 300, "a " * 120]
    texts += [prose(rng, rng.randrange(0, 90)) + " " + p + "\n" + prose(rng, rng.randrange(0, 90)) for p in (passage, other, passage, passage, other, passage + " " + passage)]
    texts += [texts[3], texts[-1], passage, passage + " x", "y " + passage, prose(rng, 4000) + " " + passage]
    got = {r.doc_id: (r.text, r.n_words, r.n_removed) for r in substrings.remove_repeated_windows(frame(spark, texts)).collect()}
    assert got == expected_kept(dict(enumerate(texts)))
    assert substrings.remove_repeated_windows(frame(spark, texts).limit(0)).count() == 0


def test_substrings_with_small_chunks_and_repeated_ids(spark, monkeypatch):
    rng = random.Random(2)
    passage = prose(rng, 80)
    docs = frame(spark, [passage, passage, prose(rng, 60) + " " + passage]).withColumn("doc_id", F.when(F.col("doc_id") == 2, 9).otherwise(5).cast("long"))
    rows = sorted((r.doc_id, r.n_removed) for r in substrings.remove_repeated_windows(docs).collect())
    assert rows == [(5, 0), (5, 0), (9, 80)]
    nobody = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert [r.n_removed for r in substrings.remove_repeated_windows(nobody).collect()] == [0, 0, 0]


# ---- chat --------------------------------------------------------------------------------------------------------------


def test_escapes_are_reversible():
    rng = random.Random(7)
    t = chat.INSTRUCT
    for _ in range(5000):
        text = "".join(rng.choice([*t.control, "<", "|", ">", "\\", "[", "INST]", "s>", " ", "a"]) for _ in range(rng.randrange(12)))
        escaped = t.escape(text)
        assert t.unescape(escaped) == text and not any(c in escaped for c in t.control)
        turns = [("user", text), (text, text), ("assistant", text), ("system", "")]
        formatted = "".join(t.marks(r)[0] + t.escape(x) + t.marks(r)[1] for r, x in turns)
        assert [(r, t.unescape(x)) for r, x in t.read(formatted)] == turns


def test_chats(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a </s>"), (2, 0, "assistant", None), (2, 1, "assistant", "x\\"), (None, 0, None, "z"), (3, 0, "user", "q"), (3, 0, "user", "q"), (4, 0, "user", "u" * 10**6)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1)).withColumn("last", F.lit("x"))
    got = {r.conv: r for r in chat.read_back(chat.format_chats(turns)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\na </s>\nassistant\nb\n") and got[1].loss_sha256 == sha("b") and got[1].valid
    assert got[2].turns_sha256 == sha("assistant\n\nassistant\nx\\\n") and got[2].loss_chars == 2 and not got[2].valid
    assert got[None].turns_sha256 == sha("\nz\n") and got[3].n_turns == 2 and not got[3].valid and not got[4].valid
    segments = chat.format_chats(turns).collect()
    assert got[4].formatted_chars == sum(len(r.text) for r in segments if r.conv == 4)
    assert chat.read_back(chat.format_chats(turns.limit(0))).count() == 0


# ---- pages -------------------------------------------------------------------------------------------------------------

BESIDE = [
    "<nav><ul><li><a href='/x'>Home</a></ul></nav>", "<header><h1>Site</h1></header>", "<aside>See also</aside>", "<div class='sidebar left'>Links <div>more</div></div>", "<form>Mail <input name=a></form>",
    "<div id=cookie-notice>We use cookies</div>", "<section id='comments'><article class='comment'>Nice!</article></section>", "<script>var a = '<p>no</p>';</script>", "<style>p{}</style>", "<!-- <p>no</p> -->",
    "<div class=\"ad\">Buy now</div>", "<footer>&copy; us</footer>",
]


def test_main_text(spark):
    weights = pages.fit(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    rng = random.Random(3)
    for _ in range(60):
        before, inside, after = (rng.sample(BESIDE, 3) for _ in range(3))
        page = f"<html><head><title>T</title></head><body>{''.join(before)}<article><h2>Head &amp; tail</h2><p>One <b>bo</b>ld\n word<p>two&nbsp;three &#8211; 1 &lt; 2{inside[0]}<br>four</p></article>{''.join(after)}"
        assert pages.main_text(page, weights) == "Head & tail One bold word two three – 1 < 2 four"
    odd = [None, "", "<nav>x</nav>", "just words", "<div class=ad>never closed <article><p>text here</p></article>", "<p>a<script>never closed", "a < b > c"]
    rows = spark.createDataFrame([(i, "u", h, "old") for i, h in enumerate(odd)], "page_id long, url string, html string, n_chars string")
    got = [r.text for r in pages.extract_main_text(rows, weights).orderBy("page_id").collect()]
    assert got == ["", "", "", "just words", "text here", "a", "a < b > c"]
    assert pages.extract_main_text(rows.limit(0), pages.fit(rows.limit(0))).count() == 0


@pytest.mark.parametrize("kind", ["div", "article", "main", "section"])
@pytest.mark.parametrize("names", [
    "class='layout has-sidebar'", "class='no-sidebar'", "class='site-main with-sidebar'", "class='post comments-open'", "class='post tag-search'", "id=content-sidebar-wrap",
    "class='left-sidebar'", "class='elementor-widget-text'", "class=hasHeader", "data-role=search", "data-x='<p class=ad>'",
])
def test_names_of_wrappers_do_not_drop_the_article(kind, names):
    text = "Long text of the article with words enough " * 20
    side = "<div class='related-posts-list'><a href=x>Other things to read</a></div><div class='comment-list'><p>What others said about it</p></div><div class=ad-x-slot>Buy</div>"
    page = f"<body><header>Site</header><{kind} {names}><h1>Head</h1><p>{text}</p><p>{text}</p></{kind}>{side}<footer>us</footer></body>"
    assert pages.main_text(page, pages._weights({})) == " ".join(f"Head {text} {text}".split())


def test_long_attribute_values():
    weights = pages._weights({})
    for n in (10, 5000, 10**6):
        value = "{&quot;a&quot;: '<p>not text</p>'} " * (n // 30) + "<b>"
        assert pages.main_text(f'<div data-json="{value}" class="sidebar">side side</div><p>the text of it', weights) == "the text of it"
        assert pages.main_text(f'<p data-json="{value}">the text</p>', weights) == "the text"
    assert pages.main_text('<p title="open>the text</p>', weights) == "the text"


def test_given_pages(spark):
    import html
    import re

    from texelmill.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in QUERIES["op8_main_text"](spark, folder).collect()}
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        inner = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", re.search("<article>(.*)</article>", r.html, re.DOTALL)[1]))
        assert got[r.page_id].text == " ".join(html.unescape(inner).split()) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_best_stretch_by_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        scored = [float(rng.randint(-4, 4)) for _ in range(rng.randint(0, 25))]
        begin, end = pages.best_stretch(scored)
        most = max((sum(scored[i:j]) for i in range(len(scored)) for j in range(i + 1, len(scored) + 1)), default=0.0)
        assert sum(scored[begin:end]) == max(most, 0.0)


@pytest.fixture(scope="module")
def learned(spark):
    return pages.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_parts_beside_the_article_that_no_list_names(learned):
    text = " ".join(f"word{i}" for i in range(61))
    assert learned.word > 0 > learned.link and learned.mark > 0 and all(w < 0 for w in learned.tags.values())
    assert pages.main_text("<article><p>one two three</p></article><section class='discussion'><p>I like it a lot really</p></section>", learned) == "one two three"
    listed = "".join(f"<li>item {i} of list</li>" for i in range(40))
    assert pages.main_text(f"<article><p>{text}</p></article><ul>{listed}</ul>", learned) == text
    assert pages.main_text(f"<article><p>{text}</p><ul>{listed}</ul></article>", learned) == " ".join([text, *(f"item {i} of list" for i in range(40))])
    links = "".join(f"<li><a href='/{i}'>a longer link that leads to page {i}</a></li>" for i in range(40))
    for body in (f"<p>{text}</p>", f"<h1>Head</h1><p>{text}<p>{text}", f"<p>{text}<br>{text} <b>bold</b> <a href=x>link</a> {text}</p>"):
        want = pages.main_text(f"<article>{body}</article>", learned)
        assert text in want
        # no mark on the page: the scan alone decides
        assert pages.main_text(f"<body><ul>{links}</ul><div>By me</div><div><div>{body}</div></div><div>short</div><ul>{links}</ul><div>&copy; us</div></body>", learned) == want


@pytest.mark.parametrize("piece", ["<i></b>x ", "<i></p>x ", "<div><li></li>x ", "<i><td></td>x ", "<i><p></p>x ", "<!", "<?", "<a x='", "<a ='>' ", "</", "<b class=ad>x ", "<div class=left-sidebar>x "])
def test_long_pages_take_linear_time(learned, piece):
    import time

    start = time.process_time()
    pages.main_text(piece * (2_000_000 // len(piece)), learned)
    assert time.process_time() - start < 30


# ---- fingerprints ------------------------------------------------------------------------------------------------------


def test_fingerprints(spark):
    rng = random.Random(5)
    base = prose(rng, 300)
    texts = [base, base, prose(rng, 300), None, "", " ", "é" * 10, base + " more", base[: len(base) // 2]]
    ids = [5, 7, 1, 2, 3, 11, 12, 20, 21]
    docs = frame(spark, texts).withColumn("doc_id", F.element_at(F.array(*map(F.lit, ids)), (F.col("doc_id") + 1).cast("int")).cast("long"))
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs).collect()}
    of = {i: t or "" for i, t in zip(ids, texts)}
    order = sorted(ids, reverse=True)
    for i, d in enumerate(order):
        follow = of[order[(i + 1) % len(order)]]
        m = len(of[d]) // 3
        edited = of[d][: len(of[d]) - m] + follow[:m]
        a, b, c = Counter(words(of[d])), Counter(words(edited)), Counter(words(follow))
        like = lambda x, y: sum((x & y).values()) / sum((x | y).values()) if x or y else 1.0
        assert got[d].n_chars == len(of[d]) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(got[d].near_edited - like(a, b)) < 0.25 and abs(got[d].near_next - like(a, c)) < 0.25
        assert bool(got[d].fingerprint) == bool(a)
    assert got[5].fingerprint == got[7].fingerprint != got[1].fingerprint
    assert fingerprints.fingerprint_documents(docs.limit(0)).count() == 0
    twice = fingerprints.fingerprint_documents(docs.where("doc_id = 1").union(docs.where("doc_id = 1"))).collect()
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0].near_next == 1.0


def test_fingerprints_by_brute_force(spark):
    """Every sample of every whole text, computed anew term by term."""
    import math
    import struct

    import xxhash

    def hashed(data: bytes) -> int:
        return xxhash.xxh64(data, seed=42).intdigest()

    def signed(x: int) -> bytes:
        return struct.pack("<Q", x % 2**64)

    table = [float(f"{x:.6g}") for x in fingerprints.gamma_quantiles()]
    logs = [float(f"{math.log(x):.6g}") for x in fingerprints.gamma_quantiles()]

    def printed(text: str) -> str:
        out = []
        terms = Counter(words(text))
        for block in range(fingerprints.BLOCKS if terms else 0):
            for j in range(fingerprints.WIDTH):
                least = math.inf
                for word, n in terms.items():
                    term = hashed(word.encode()) ^ ((block + 1) * 0xD1B54A32D192ED03 % 2**63)
                    bits = hashed(signed(term ^ ((j * 0x9E3779B97F4A7C15) % 2**63)))
                    r, log_c, b = table[bits % len(table)], logs[(bits >> 8) % len(table)], (bits >> 16) * 2.0**-48
                    least = min(least, log_c - r * (math.floor(math.log(n) / r + b) - b + 1))
                out.append(f"{hashed(struct.pack('<d', least)) & 0xFFFF:04x}")
        return "".join(out)

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    given = [(r.doc_id, r.text or "") for r in docs.orderBy(F.desc("doc_id")).collect()]
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs).collect()}
    assert len(got) == len(given)
    same = total = 0
    share = lambda a, b: sum(a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)) * 4 / len(a) if a and b else float(a == b)
    for i, (doc, text) in list(enumerate(given))[:: max(1, len(given) // 40)]:
        follow = given[(i + 1) % len(given)][1]
        m = len(text) // 3
        edited = text[: len(text) - m] + follow[:m]
        row = got[doc]
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for a, b in ((row.fingerprint, printed(text)), (row.edited_fingerprint, printed(edited))):
            assert len(a) == len(b)
            same, total = same + sum(a[j : j + 4] == b[j : j + 4] for j in range(0, len(a), 4)), total + len(a) // 4
        assert row.near_edited == share(row.fingerprint, row.edited_fingerprint) and row.near_next == share(row.fingerprint, got[given[(i + 1) % len(given)][0]].fingerprint)
    # the two logarithms may differ in the last bit
    assert total and same >= 0.995 * total


def test_gamma_quantiles():
    import math

    q = fingerprints.gamma_quantiles()
    assert all(abs(1 - (1 + x) * math.exp(-x) - (i + 0.5) / len(q)) < 1e-9 for i, x in enumerate(q))


# ---- words whose letters sum up alike -------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1024, 2048])
def test_sums_of_letters_are_not_words(spark, n):
    from tests.llm.test_bpe import thue_morse

    a, b = thue_morse(n)
    got = {r.doc_id: r for r in ngram_join.similar_groups(spark.createDataFrame([(1, a), (2, b), (3, f"{a} {b}"), (4, f"{b} {a}"), (5, b)], "doc_id long, text string")).collect()}
    assert [got[i].component_id for i in range(1, 6)] == [1, 2, 3, 4, 2]
    head = " ".join(f"w{i}" for i in range(49))
    texts = [f"{head} {a}", f"{head} {b}", f"{head} {a}"]
    kept = {r.doc_id: r.n_removed for r in substrings.remove_repeated_windows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == {0: 0, 1: 0, 2: 50}
    # shingles and windows whose words are dealt out by the same pattern
    one, two = thue_morse(64)
    texts = [" ".join(one), " ".join(two)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(60)} for t in texts]
    linked = 100 * len(sets[0] & sets[1]) >= 80 * len(sets[0] | sets[1])
    rows = ngram_join.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {0: (len(sets[0]), 0), 1: (len(sets[1]), 0 if linked else 1)}


def test_hashes_of_words_and_grams():
    import numpy as np
    import pyarrow as pa

    from texelmill.llm import words as w

    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abé") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 130]))) for _ in range(rng.randrange(60))) for _ in range(200)]
    own = w.Words(*w.text_buffer(pa.array(texts)))
    flat = [x for t in texts for x in words(t)]
    assert len(own.hash) == len(flat)
    assert len(set(zip(own.hash.tolist(), flat))) == len(set(flat)) == len(set(own.hash.tolist()))
    for n in (1, 2, 5, 20, 50):
        grams, first = own.grams(n)
        said = [tuple(words(t)[i : i + n]) for t in texts for i in range(len(words(t)) - n + 1)]
        assert len(grams) == len(said) == first[-1]
        assert len(set(zip(grams.tolist(), said))) == len(set(said)) == len(set(grams.tolist()))
    assert len(w.byte_hashes(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def test_ngram_join_compares_a_large_group_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(7)
    base, texts = [f"w{i}" for i in range(100)], []
    for doc in range(300):
        own = list(base)
        for place in rng.choice(np.arange(2, 98, 2), 2, replace=False):
            own[place] = f"own{doc}x{place}"
        texts.append(" ".join(own))
    asked, plain = [], ngram_join.plausible

    def plausible(pairs, sets, lists):
        asked.append(pairs.count())
        return plain(pairs, sets, lists)

    monkeypatch.setattr(ngram_join, "plausible", plausible)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 64)
    monkeypatch.setattr(ngram_join, "SLICE", 50)
    got = {r.doc_id: r.component_id for r in ngram_join.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(96)} for t in texts]
    root = list(range(300))
    for _ in range(300):
        before = list(root)
        for i in range(300):
            for j in range(i):
                if root[i] != root[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    assert 20 < len(set(root)) < 290
    assert got == dict(enumerate(root))
    assert sum(asked) < 10_000, asked  # of 44850 pairs


def test_ngram_join_gives_its_disk_back(spark, monkeypatch):
    """Texts are held only of sets that are compared, and no table of texts, shingles or signatures is left behind."""
    from pathlib import Path

    rng = random.Random(5)
    texts = [prose(rng, 80, 10**6) for _ in range(30)]
    texts += [" ".join([*words(t)[:-1], "changed"]) for t in texts[:4]]  # four linked pairs
    texts += [" ".join([*words(texts[9])[:9], *words(prose(rng, 300, 10**6))])]  # shares shingles with another, but no link is possible by size
    held, plain = [], ngram_join.cut_lineage

    def cut(df):
        table = plain(df)
        held.append((table.columns, table.count(), Path(vars(table).get("_written_to", "").removeprefix("file:"))))
        return table

    monkeypatch.setattr(ngram_join, "cut_lineage", cut)
    got = {r.doc_id: r.component_id for r in ngram_join.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: i - 30 if 30 <= i < 34 else i for i in range(35)}
    assert [n for columns, n, _ in held if "text" in columns] == [8, 0]
    left = {c for columns, _, path in held if path.exists() for c in columns}
    assert left & {"id", "n"} and not left & {"text", "signature", "signatures", "shingles"}


def test_tables_leave_no_shuffle_files(spark):
    """Shuffle files go when the table that needed them is written, not when the driver collects its garbage; the setting of the session stays as it was."""
    import time

    from texelmill.session import SHUFFLES_GO, cut_lineage, drop_tables

    def shuffles():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().iterator()
        found = set()
        while blocks.hasNext():
            found.add(blocks.next().name())
        return {x for x in found if x.startswith("shuffle_")}

    before, setting = shuffles(), spark.conf.get(SHUFFLES_GO, None)
    frame_ = spark.range(20_000).groupBy((F.col("id") % 997).alias("k")).agg(F.sum("id").alias("s"))
    kept = frame_.groupBy("s").count()
    assert kept.count() == 997 and shuffles() - before  # an action of the session keeps its files while the frame is there
    others = shuffles()
    table = cut_lineage(frame_.join(frame_.select("k", F.col("s").alias("t")), "k"))
    until = time.time() + 20
    while shuffles() - others and time.time() < until:
        time.sleep(0.1)
    assert not shuffles() - others
    assert spark.conf.get(SHUFFLES_GO, None) == setting
    assert table.count() == 997 and table.where("s = t").count() == 997
    drop_tables(table)
    with pytest.raises(Exception, match="(?i)not.*exist|no such file|FILE_NOT"):
        table.count()


def test_ngram_join_shared_counts():
    import numpy as np

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (0, 1, 40, 90, 200, 90)]
    for left, right in (([0, 1, 2, 3], [4, 5]), ([0, 1, 2, 3, 4, 5],) * 2, ([0], [0])):
        expected = [[len(np.intersect1d(sets[i], sets[j])) for j in right] for i in left]
        assert ngram_join.shared(sets, np.array(left), np.array(right)).tolist() == expected
