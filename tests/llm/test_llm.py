"""The operators on small inputs: nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, and
against brute force."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.llm import bpe, html, jaccard, licenses, mixing, quality_model, quality_rules, topk, toxicity, warc
from quernel.llm.common import Scratch, tokenizer_file

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n int, size string, words string, cid string"
LABELS = "doc_id bigint, quality int, toxic int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, source="s"):
    """A table of documents with extra columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(i, t, "en", source if isinstance(source, str) else source[k], None, 1, "x", "y", "z") for k, (i, t) in enumerate(texts)], DOCS)


def odd(rng):
    base = " ".join(rng.choice(["ab", "cd", "ef", "gh", "Ij", "kl"]) + str(rng.randrange(30)) for _ in range(150))
    near = base.split()
    near[70] = "other"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \t\n "), (7, "one two"), (8, "ONE two"), (9, "a b c d e"), (10, base.upper()), (None, base), (11, "x " * 3000), (12, "é" * 40 + "   z"), (1, base)]
    return rows


def test_jaccard_against_brute_force(spark):
    rng = random.Random(5)
    rows = odd(rng)
    for k in range(60):  # chains of near copies of one text
        words = rows[0][1].split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(9)}"
        rows.append((100 + k, " ".join(words)))
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def shingles(t):
        w = WORD.findall((t or "").translate(low))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        inter = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * inter >= 80 * (len(sets[a]) + len(sets[b]) - inter):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = jaccard.link(docs_of(spark, rows), Scratch(spark)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), root(r["doc_id"]))
        else:
            assert r["component_id"] is None
    assert jaccard.link(docs_of(spark, rows).limit(0), Scratch(spark)).count() == 0


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 16))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[200:260] = vectors[7]  # ties
    huge = [[2e5] + [0.0] * 15, [-3e38] * 16, [3e38] * 8 + [1.0] * 8]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(None, [0.1] * 16), (1000, None), (1001, [0.1] * 15 + [None]), (1002, [float("nan")] * 16), (1004, [float("inf")] * 16), (1003, []), (1006, []), (1050, []), (1100, [0.5] * 3)]
    rows += [(50, [float(x) for x in vectors[51]]), (50, [float(x) for x in vectors[50]]), (2000, [float(x) for x in vectors[7]]), (1007, huge[0]), (1008, huge[1]), (1150, huge[2])]
    df = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], "vec_id bigint, embedding array<float>, score int, id int, v int, dim string")
    live = [(i, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    limit = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = collections.Counter()
    for q, x in {(i, v) for i, v in live if i % 50 == 0}:
        best = sorted((-limit(sum(a * b for a, b in zip(x, y, strict=True))), i) for i, y in live if i != q and len(y) == len(x))[:5]
        want.update((q, n + 1, i, -s) for n, (s, i) in enumerate(best))
    assert {i for i, *_ in want} == {0, 50, 100, 150, 200, 250, 1000 + 50, 1150, 2000} and (1100, 1) not in {w[:2] for w in want}
    for blocks in ({"block": 64, "query_block": 1}, {"block": 64, "query_block": 3}, {}):
        got = topk.search(df, every=50, **blocks).collect()
        assert collections.Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want
    assert topk.search(df.limit(0)).count() == 0


def test_topk_stops_on_proof():
    """Clustered rows: the index proves its result before it has seen all postings; scattered signs and sizes give the same rows as
    brute force."""
    rng = np.random.default_rng(4)
    for spread, scale in ((0.1, 40), (1.0, 40), (1.0, 1), (3.0, 100_000)):
        centres = rng.normal(size=(20, 32)) * scale
        rows = np.floor(centres[rng.integers(20, size=2000)] + rng.normal(size=(2000, 32)) * scale * spread).astype(np.int64)
        ids = rng.permutation(2000) // 2
        index = topk.Index(rows, ids)
        for i in range(0, 2000, 40):
            found, scores = index.best(rows[i], int(ids[i]), 5)
            full = rows @ rows[i]
            order = [j for j in np.lexsort((ids, -full)) if ids[j] != ids[i]][:5]
            assert list(scores) == list(full[order]) and list(ids[found]) == list(ids[order])
        if spread == 0.1:
            assert index.postings < 0.8 * 50 * rows.size
    assert len(topk.Index(rows[:1], ids[:1]).best(rows[0], int(ids[0]), 5)[0]) == 0


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file())
    texts = [None, "", "  ", "Don't I'LL <|endoftext|>x<|startoftext|>", "ΟΔΟΣ Σ", "a" * 300, "日本語 ½ 12 é é", "the\x1cand\x85then", "quiltwort " * 5000, "<|endoftext"]
    got = bpe.encode(docs_of(spark, list(enumerate(texts))), ids=True).orderBy("doc_id").collect()
    for t, r in zip(texts, got, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    decoded = bpe.decode(bpe.encode(docs_of(spark, [(0, "The cat")]), ids=True)).first()["text"]
    assert decoded == library.decode(library.encode("The cat", add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.encode(docs_of(spark, [(0, "x")]).limit(0)).count() == 0


def test_quality_counts_and_control(spark):
    rng = random.Random(1)
    line = " ".join(f"w{i}" for i in range(9))
    rows = [*odd(rng), (20, "\n".join([line, line, "other words here", " ", line])), (21, "a # b $$ c\n" * 3)]
    made = [(1000 + i, " ".join(f"v{rng.randrange(500)}" for _ in range(40)) + (" ##" * 20 if i % 4 == 0 else "")) for i in range(4000)]
    labels = spark.createDataFrame([(1000 + i, int(i % 4 != 0), 0) for i in range(4000)] + [(None, 1, 1), (20, None, None)], LABELS)
    got = {r["doc_id"]: r for r in quality_rules.judge(docs_of(spark, rows + made), labels, Scratch(spark)).collect() if r["doc_id"] is not None}
    for i, t in rows:
        if i is None:
            continue
        w, t = WORD.findall(t or ""), t or ""
        seen, dup = set(), 0
        for x in t.split("\n"):
            if WORD.search(x):
                dup += x in seen
                seen.add(x)
        count = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        covered = {k for j in range(len(w) - 7) if count[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)}
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)), i
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
    assert all(got[1000 + i]["kept"] == (i % 4 != 0) for i in range(4000))
    free = quality_rules.judge(docs_of(spark, rows), labels.limit(0), Scratch(spark))
    assert free.where("kept = base_failed").count() == 0
    assert quality_rules.judge(docs_of(spark, rows).limit(0), labels, Scratch(spark)).count() == 0


def test_joint_cutoffs(spark):
    """500 good documents are too few for the grid of op4's SQL, not for the joint tests; a stratum too small for any gets none."""
    rng = random.Random(2)
    text = lambda bad: " ".join(f"v{rng.randrange(500)}" + "##" * bad for _ in range(40))
    rows = [(i, text(i % 5 == 0), "de" if i < 625 else "fr", "s", None, 1, "x", "y", "z") for i in range(725)]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(725)], LABELS)
    kept = lambda joint: {r["doc_id"] for r in quality_rules.judge(docs, labels, Scratch(spark), joint=joint).where("kept").collect()}
    assert kept(False) == set(range(725))
    assert kept(True) == {i for i in range(725) if i >= 625 or i % 5}
    assert quality_rules.judge(docs, labels.limit(0), Scratch(spark), joint=True).where("not kept and not base_failed").count() == 0
    # More than the share of good documents look bad: nothing is rejected.
    mixed = spark.createDataFrame([(i, int(i % 5 != 0 or i % 25 == 0), 0) for i in range(725)], LABELS)
    assert quality_rules.judge(docs, mixed, Scratch(spark), joint=True).where("not kept").count() == 0


def test_binomial_tail(spark):
    import math

    rows = [(0, 10), (3, 400), (7, 2000), (50, 100)]
    got = spark.createDataFrame(rows, "k bigint, n bigint").select("k", "n", quality_rules.binomial_tail("k", "n", 0.01).alias("p")).collect()
    for r in got:
        exact = sum(math.comb(r["n"], i) * 0.01**i * 0.99 ** (r["n"] - i) for i in range(r["k"] + 1)) if r["k"] < r["n"] * 0.01 else 1.0
        assert r["p"] == pytest.approx(exact, rel=1e-9)


def test_mixing(spark):
    rng = random.Random(2)
    sizes = [(i, " ".join(["w"] * rng.randrange(1, 60))) for i in range(900)]
    sources = [rng.choice(["a", "b", "c", None]) if i > 300 else "a" for i in range(900)]
    docs = docs_of(spark, [*sizes, (900, None), (901, ""), (1, sizes[1][1]), (None, "w w")], [*sources, "d", "a", sources[1], "b"])
    got = mixing.mix(docs, Scratch(spark)).collect()
    assert len(got) == 904 and sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs, Scratch(spark)).collect()))
    by = collections.defaultdict(lambda: [0, 0])
    for r in got:
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        by[r["source_size"], r["target"]][0] += r["size"]
        by[r["source_size"], r["target"]][1] += r["taken"]
    for (size, target), (found, taken) in by.items():
        assert found == size and abs(taken - target) <= 60
    assert sum(t for _, t in by) == pytest.approx(sum(s for s, _ in by))
    mixed = mixing.mixed(docs, Scratch(spark))
    assert mixed.columns == docs.columns
    words = mixed.select(F.sum(mixing.words_in())).first()[0]
    assert words == sum(r["taken"] for r in got)
    assert mixing.mix(docs.limit(0), Scratch(spark)).count() == 0


def test_mixing_against_a_fold(spark):
    """The trades one after the other in plain Python, from the same hashes."""
    import math
    import struct

    import xxhash

    def hashed(*values):
        h = 42
        for kind, v in values:
            h = xxhash.xxh64_intdigest(struct.pack(f"<{kind}", v), seed=h)
        return h - (1 << 64) if h >> 63 else h

    longs = lambda *v: [("q", x) for x in v]
    unit = lambda *v: hashed(*v) % 2**31 / 2**31
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60))) for i in range(400)]
    sources = [rng.choice(["a", "a", "a", "b", None]) for _ in rows]
    docs = docs_of(spark, rows, sources)
    sizes = collections.Counter()
    for (_, t), s in zip(rows, sources, strict=True):
        sizes[s] += len(t.split())
    goal = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size bigint")).collect()}
    copies = {}
    open_ = collections.defaultdict(list)
    for (i, t), s in zip(rows, sources, strict=True):
        ideal = goal[s] / sizes[s]
        base = round(ideal) if abs(ideal - round(ideal)) < 1e-9 else math.floor(ideal)
        copies[i] = base
        if abs(ideal - round(ideal)) >= 1e-9:
            open_[s].append((i, len(t.split()), ideal - base))
    for level in range(64):
        if max(map(len, open_.values()), default=0) <= 1:
            break
        for s, items in open_.items():
            chunks = collections.defaultdict(list)
            for i, n, p in items:
                chunks[hashed(*longs(i, n), ("i", 17), ("i", level)) % math.ceil(len(items) / 32)].append((hashed(*longs(i, n), ("i", 17 + level)), i, n, p))
            left = []
            for chunk in chunks.values():
                cur = None
                for _, i, n, p in sorted(chunk):
                    if cur is None:
                        cur = (i, n, p)
                        continue
                    ci, cn, cp = cur
                    up, down = min(1 - cp, p * n / cn), min(cp, (1 - p) * n / cn)
                    rises = unit(*longs(ci, cn, i, n), ("i", 17), ("i", level)) * (up + down) < down
                    first_done = up >= 1 - cp if rises else down >= cp
                    if first_done:  # the one at hand is 0 or 1 now, the other goes on
                        copies[ci] += rises
                        cur = (i, n, min(1.0, max(0.0, p + (-up if rises else down) * cn / n)))
                    else:
                        copies[i] += not rises
                        cur = (ci, cn, min(1.0, max(0.0, cp + (up if rises else -down))))
                left.append(cur)
            open_[s] = [x for x in left if x[2] > 0]
    for items in open_.values():
        for i, n, p in items:
            copies[i] += unit(*longs(i, n), ("i", 17)) < p
    got = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(docs, Scratch(spark)).collect()}
    assert got == copies


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 900), (None, 50)], "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    # Weights 1, 2, 3, 1: b stops at 30, then null at 150 and a at 206 by the rest's weight.
    assert got["b"] == 30 and sum(got.values()) == pytest.approx(1060)
    assert got[None] == 150 and got["a"] == pytest.approx((1060 - 180) / 4) and got["c"] == pytest.approx(3 * (1060 - 180) / 4)


def test_toxicity(spark):
    clean = [(i, f"the weather number {i} is fine today and we walk. You are an early and such a kind guest") for i in range(300)]
    toxic = [(1000 + i, f"you are an idiot and a stupid clown {i}. Such trash.") for i in range(80)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in clean] + [(i, 1, 1) for i, _ in toxic] + [(None, 1, 1), (5, 1, None)], LABELS)
    docs = docs_of(spark, [*clean, *toxic, (5000, None), (5001, ""), (None, "x"), (5002, "fine " * 20 + "you idiot, you moron, worthless scum"), (5003, "fine " * 90_000)])
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    assert all(got[i]["predicted"] == 0 for i, _ in clean) and all(got[i]["predicted"] == 1 for i, _ in toxic)
    assert got[5000]["score"] == got[5001]["score"] and got[5002]["predicted"] == 1
    import zlib

    assert all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    flagged = toxicity.flagged(docs, labels, "bad")
    assert flagged.columns == [*docs.columns, "bad"] and flagged.where("bad = 1").count() == 81
    with pytest.raises(ValueError):
        toxicity.flagged(docs, labels, "words")
    again = toxicity.score(docs.repartition(5), labels.repartition(3))
    assert {r["doc_id"]: r["score"] for r in again.collect()} == {i: r["score"] for i, r in got.items()}
    assert toxicity.score(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.5}


def test_toxicity_without_labels(spark):
    docs = docs_of(spark, [(1, "fine weather"), (2, "you idiot"), (3, None)])
    labels = spark.createDataFrame([], LABELS)
    assert toxicity.flagged(docs, labels).where("toxic = 0").count() == 3
    assert {r["predicted"] for r in toxicity.score(docs, labels).collect()} == {0}


def test_grammar_clauses():
    g = toxicity.Grammar({"grobnik": 2.0})
    put = lambda t: g.clause(t.lower().split())
    assert put("an idiot") == {"insult": 1.0} and put("you idiot") == {"insult": toxicity.AIMED} and put("I will kill you") == {"threat": 1.0}
    assert put("such a grobnik") == {"learned": 2.0} and put("you grobnik") == {"learned": 2 * toxicity.AIMED} and put("fine weather") == {}
    assert put("not an idiot") == {"insult": toxicity.NEGATED} and put("maria said idiot") == {"insult": toxicity.REPORTED}
    assert put("you are not an idiot") == {"insult": pytest.approx(toxicity.AIMED * toxicity.NEGATED)}
    assert g.features("She said so. idiot")[0] == 1.0 and g.features("one. two. three") == [0.0] * toxicity.WIDTH
    # A word counts by the clause around it only, never by itself: the same words score by what surrounds them.
    w = toxicity.learn(np.array([g.features(t) for t in ["you idiot", "you moron, you scum"] * 30 + ["fine weather", "we walk home"] * 90]), np.array([1.0] * 60 + [0.0] * 180))
    z = lambda t: float((toxicity.scaled(np.array([g.features(t)])) @ w)[0])
    assert z("not an idiot") < z("an idiot") < z("you idiot") and z("she said idiot") < z("you idiot") and z("maria said idiot") < z("an idiot")
    assert z("you are not an idiot") < z("you are an idiot") and (w[1:] >= 0).all()


def test_grammar_against_brute_force():
    """The composed transducer against the definition: the words before decide each word's factor."""
    rng = random.Random(6)
    symbols = toxicity.classes()
    vocabulary = ["idiot", "kill", "you", "not", "said", "grobnik", "walk", "home"]
    g = toxicity.Grammar({"grobnik": 2.0})
    for _ in range(500):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(12))]
        want = collections.defaultdict(float)
        for i, w in enumerate(words):
            kind = {"I": "insult", "H": "threat"}.get(symbols.get(w), "learned" if w == "grobnik" else "")
            if kind:
                factor = toxicity.AIMED if "you" in words[max(0, i - toxicity.NEAR) : i] else 1.0
                factor *= toxicity.NEGATED if "not" in words[max(0, i - toxicity.SCOPE) : i] else 1.0
                want[kind] += (2.0 if kind == "learned" else 1.0) * factor * (toxicity.REPORTED if "said" in words[:i] else 1.0)
        assert g.clause(words) == pytest.approx(dict(want))


def test_quality_model(spark):
    rng = random.Random(4)
    good = [(i, " ".join(rng.choice(["the", "of", "river", "stone", "walks"]) for _ in range(60)) + ".") for i in range(400)]
    bad = [(1000 + i, " ".join(rng.choice(["buy##", "$$$", "now!!", "|"]) for _ in range(60))) for i in range(150)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 1), (3, None, 0)], LABELS)
    docs = docs_of(spark, [*good, *bad, (5000, None), (5001, ""), (None, "x"), (5002, "stone " * 20000)])
    got = {r["doc_id"]: r for r in quality_model.score(docs, labels).collect()}
    held = [r for i, r in got.items() if i is not None and i < 2000 and r["held_out"]]
    assert held and all(r["predicted"] == int(r["doc_id"] < 1000) for r in held)
    assert got[5000]["score"] == got[5001]["score"] and all(0 <= r["score"] <= 1 for r in got.values())
    assert quality_model.score(docs.limit(0), labels).count() == 0
    assert len({r["score"] for r in quality_model.score(docs, labels.limit(0)).collect()}) == 1


def test_trees_against_all_splits():
    rng = np.random.default_rng(7)
    value = lambda g, h: (g * g / (h + 5.0)) if h or g else 0.0
    for n in (1, 2, 5, 9):
        g, h = rng.normal(size=n), rng.random(n)
        best = max(sum(value(g[a:b].sum(), h[a:b].sum()) for a, b in ((0, i), (i, j), (j, n))) for i in range(n + 1) for j in range(i, n + 1))
        out = quality_model.tree(g, h)
        cuts = [0, *(k + 1 for k in range(n - 1) if out[k] != out[k + 1]), n]
        assert len(cuts) <= 4
        assert sum(value(g[a:b].sum(), h[a:b].sum()) for a, b in itertools.pairwise(cuts)) == pytest.approx(best)
        assert all(out[a] == pytest.approx(g[a:b].sum() / (h[a:b].sum() + 5.0)) for a, b in itertools.pairwise(cuts))
    for shape in ((1, 1), (3, 4), (5, 2)):
        g, h = rng.normal(size=shape), rng.random(shape)
        parts = lambda x, i, j: (x[:i, :j].sum(), x[:i, j:].sum(), x[i:, :j].sum(), x[i:, j:].sum())
        best = max(sum(map(value, parts(g, i, j), parts(h, i, j))) for i in range(shape[0] + 1) for j in range(shape[1] + 1))
        gain, out = quality_model.quadrants(g, h)
        assert gain == pytest.approx(best) and (out * (g - out * 0)).shape == shape
        assert any(np.allclose(out, np.block([[np.full((i, j), a), np.full((i, shape[1] - j), b)], [np.full((shape[0] - i, j), c), np.full((shape[0] - i, shape[1] - j), d)]])) for i in range(shape[0] + 1) for j in range(shape[1] + 1) for a, b, c, d in [tuple(x / (y + 5.0) for x, y in zip(parts(g, i, j), parts(h, i, j), strict=True))])


def test_warc_round_trip(spark):
    pages = [(1, "http://a/1", "<p>x</p>" * 20_000), (2, "http://a/2", "same"), (3, "http://a/3", "same"), (4, None, None), (5, "u", ""), (None, "v", "same"), (6, "w", "é日本" * 9_000), (6, "w", "é日本" * 9_000), (7, "bad\r\nX-Page-Key: 9", "z")]
    df = spark.createDataFrame([(*p, "q") for p in pages], "page_id bigint, url string, html string, kind string")
    got = warc.round_trip(df, Scratch(spark), segment_bytes=10_000, archive_bytes=40_000).collect()
    assert len(got) == len(pages) and all(r["status"] == "whole" for r in got)
    for r in got:
        payload = next((h or "") for i, _, h in pages if i == r["page_id"]).encode()
        assert r["payload_bytes"] == len(payload) and r["payload_digest"] == warc.base32_sha1(payload)
    facts = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got)
    assert facts == [(0, "revisit", 3), (1, "response", None), (2, "revisit", 3), (3, "response", None), (4, "revisit", 5), (5, "response", None), (6, "response", None), (6, "response", None), (7, "response", None)]
    assert warc.round_trip(df.limit(0), Scratch(spark)).count() == 0


def test_warc_reads_each_byte_once():
    import time

    members = [warc._record([("WARC-Type", "resource")], bytes([i % 251]) * 3_000) for i in range(20_000)]
    for content in (b"".join(members), members[0], b""):
        assert [len(b) for _, b in warc.parse_archive(content)] == [3_000] * (len(content) and content.count(b"\x1f\x8b\x08") if len(content) < 10_000 else 20_000)
    began = time.process_time()
    assert sum(1 for _ in warc.parse_archive(b"".join(members))) == 20_000
    assert time.process_time() - began < 10
    plain = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in warc.parse_archive(plain * 3)] == [b"abc"] * 3
    big = warc._record([("WARC-Type", "resource")], random.Random(1).randbytes(500_000))
    assert [len(b) for _, b in warc.parse_archive(big * 2)] == [500_000] * 2


def test_warc_missing_segment_and_framing(spark):
    df = spark.createDataFrame([(1, "u", "y" * 50_000)], "page_id bigint, url string, html string")
    records = warc.read_records(warc.write_archives(df, Scratch(spark), segment_bytes=10_000)).where("segment is null or segment <> 3")
    r = warc.reassemble(records).first()
    assert r["status"] == "incomplete" and r["payload_bytes"] is None
    body = bytes(range(256)) * 300
    assert warc.dechunked(warc.chunked(body, 1000)) == body and warc.dechunked(warc.chunked(b"")) == b""
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nab")


def test_html():
    page = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a>Home</a></nav><div class="cookie-notice">We use cookies</div>
    <article><h1>Title &amp; more</h1><p>First <b>para</b>graph&nbsp;here.<p>Second<br>line &lt;x&gt;</p><div class="ad">Buy</div><form><input>Send</form><script>var t="</p>";</script></article>
    <aside>Related</aside><section id="comments"><p>Reader says hi</p></section><footer>&copy; me</footer></body>"""
    assert html.main_text(page) == "Title & more First paragraph here. Second line <x>"
    plain = "<body><ul><li>Home<li>About</ul><div><p>" + "</p><p>".join("A sentence that goes on for long enough to count as text, number %d." % i for i in range(5)) + "</p></div><div>ok</div></body>"
    assert html.main_text(plain).startswith("A sentence") or "number 4." in html.main_text(plain)
    assert html.main_text(None) == "" and html.main_text("") == "" and html.main_text("<nav>x</nav>") == ""
    assert html.main_text("just text") == "just text" and html.main_text("<p>unclosed <b>x") == "unclosed x"


def test_html_teaser():
    body = "<p>The page's main text lies in a plain element and goes on for much longer than the card.</p>" * 4
    got = html.main_text(f"<div>{body}</div><article><h3>Teaser</h3><p>A card.</p></article>")
    assert got.startswith("The page's main text") and got.count("much longer") == 4 and "card." not in got.replace("the card.", "")
    marked = html.main_text(f"<div>menu</div><main>{body}</main>")
    assert marked.count("much longer") == 4 and "menu" not in marked
    assert html.main_text(f"<main><p>intro</p></main><div>{body}</div>").startswith("The page's")


def test_html_box_in_mid_article():
    long, short = "<p>A first part that goes on for long enough to pass the threshold of the window.</p>" * 6, "<p>A second part that is the smaller one.</p>" * 3
    for box in ("<aside><p>a<p>b<p>c<p>d</aside>", '<ul class="related"><li>a<li>b<li>c<li>d</ul>', "<form><p>a<p>b<p>c<p>d</form>"):
        for parts in ((long, short), (short, long)):
            got = html.main_text(f"<div>{parts[0]}{box}{parts[1]}</div>")
            assert got.count("first part") == 6 and got.count("second part") == 3 and " b " not in got, box


def test_html_without_marks():
    """Menus, link lists and copyright lines in plain elements fall outside surge and dive; both parts of a parted text stay."""
    body = "<p>A sentence that goes on for long enough to count as text of the article.</p>" * 3
    page = f'<body><div><div><a href="/">Home</a></div><div><a href="/a">About us</a></div></div><div><div><h1>Title</h1>{body}<table><tr><td>cell</table>{body}</div></div><div><div></div><hr></div><div><div><div>{body}</div></div></div><div><div></div></div><div><div>(c) 2020</div></div>'
    got = html.main_text(page)
    assert got.startswith("Title A sentence") and got.count("goes on") == 9 and "cell" in got and "Home" not in got and "2020" not in got


def test_html_stretches_against_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        weights = [rng.choice([0, 0, 0, 1, 40, 90]) for _ in range(rng.randrange(1, 30))]
        window = rng.randrange(1, 6)
        sums = [sum(weights[i : i + window]) for i in range(len(weights))]
        want, i = [], 0
        while i < len(sums):
            j = i
            while j < len(sums) and sums[j] > 0:
                j += 1
            if j > i:
                want.append((i, j, max(sums[i:j]), sum(weights[i:j])))
            i = max(i + 1, j)
        assert html.stretches(np.array(weights, float), window) == want


@pytest.mark.parametrize("part", ['<a "', '<a ="', "<div>", "<b><p>", "<p>x</b>", "<div></p>", "</script", "<script></script", "<![CDATA[", "<!", "<!-", "&#1", "<li>"])
def test_html_time_is_linear(part):
    """A megabyte of unclosed or stray markup takes seconds at most; quadratic time would take many minutes."""
    import time

    began = time.process_time()
    assert html.main_text("hello " + part * (1_000_000 // len(part))).startswith("hello")
    assert time.process_time() - began < 5
    assert html.main_text("x &#" + "9" * 5000 + "; &#0000000065;") == "x � A"


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>a  b</p></article>", "t"), (2, None, None, "t"), (None, "u", "<p>x", "t")], "page_id bigint, url string, html string, text string")
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html.extract(df).collect())
    assert got == [(0, "x", 1), (1, "a b", 3), (2, "", 0)]
    assert html.extract(df.limit(0)).count() == 0


def test_licenses(spark):
    files = [("p/LICENSE", "Released under the MIT License."), ("p/src/a.c", "int x;"), ("p/src/deep/b.c", "int y;"), ("p/src/COPYING", "Licensed under the Apache License, Version 2.0."), ("q/c.c", "some code\nLicensed under CC BY-NC 4.0.\nmore"), ("r/d.c", None), (None, ""), ("p/src/a.c", "int x;")]
    df = spark.createDataFrame([(*f, 1) for f in files], "path string, text string, license int")
    got = [(r["path"] or "", r["license"], r["origin"], r["inherited_from"]) for r in licenses.scan(df, Scratch(spark)).collect()]
    a = ("p/src/a.c", "Apache-2.0", "inherited", "p/src/COPYING")
    expected = [("p/LICENSE", "MIT", "file", None), a, a, ("p/src/deep/b.c", "Apache-2.0", "inherited", "p/src/COPYING"), ("p/src/COPYING", "Apache-2.0", "file", None), ("q/c.c", "CC-BY-NC-4.0", "header", None), ("r/d.c", None, "none", None), ("", None, "none", None)]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    assert licenses.scan(df.limit(0), Scratch(spark)).count() == 0


def test_licenses_against_brute_force(spark):
    """Cosines over the passages, the best licence of each file, and the nearest ancestor by walking up."""
    import math

    rng = random.Random(9)
    notices = [t for _, t in licenses.ALL] + ["Our licence is a secret and no one may know it", "copyright is a word in this line", "", "plain text"]
    folders = ["", "a", "a/b", "a/b/c", "a/d", "e", "e/f/g"]
    files = []
    for n in range(120):
        folder, name = rng.choice(folders), rng.choice(["LICENSE", "COPYING.txt", "LICENSE-2", "x.c", "y.py", "z.txt"]) if rng.random() < 0.5 else f"f{n}.c"
        files.append((f"{folder}/{name}".lstrip("/"), "\n".join(rng.choice(notices) if rng.random() < 0.4 else "just code" for _ in range(rng.randrange(1, 4))), n))
    df = spark.createDataFrame(files, "path string, text string, doc_id bigint")
    cut = {r["doc_id"]: list(dict.fromkeys([*r["p"], *([r["text"]] if re.search(licenses.LICENSE_FILE, r["path"]) else [])])) for r in df.select("*", licenses.passages_of(F.col("text")).alias("p")).collect()}

    def grams(t):
        w = re.findall(r"[a-z]+|[0-9]+(?:\.[0-9]+)*", t.lower())
        return collections.Counter([*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))])

    known = [grams(t) for _, t in licenses.ALL]
    n = len(known)
    df_of = collections.Counter(g for k in known for g in k)
    idf = lambda g: math.log((1 + n) / (1 + df_of[g])) + 1
    vector = lambda c: {g: f * idf(g) for g, f in c.items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = [(s, vector(k), size(vector(k))) for (s, _), k in zip(licenses.ALL, known, strict=True)]
    own = {}
    for i, parts in cut.items():
        best = None
        for v in map(vector, map(grams, parts)):
            if not v:
                continue
            of_passage = max((round(sum(x * v.get(g, 0) for g, x in t.items()) / (size(v) * tn), 9), -k, s) for k, (s, t, tn) in enumerate(templates))
            if of_passage[0] >= 0.6:
                best = max(best or (), (of_passage[2] != "LicenseRef-proprietary", of_passage[0], of_passage[2]))
        own[i] = best
    up = lambda p: p.rsplit("/", 1)[0] if "/" in p else ""
    speaks = collections.defaultdict(list)
    for p, _, i in files:
        if own[i] and re.search(licenses.LICENSE_FILE, p):
            speaks[up(p)].append((own[i][1], own[i][2], p))
    got = {r["doc_id"]: r for r in licenses.scan(df, Scratch(spark), carry=("doc_id",)).collect()}
    assert len(got) == len(files) and {r["origin"] for r in got.values()} == {"file", "header", "inherited", "none"}
    for p, _, i in files:
        if own[i]:
            assert (got[i]["license"], got[i]["score"]) == (own[i][2], pytest.approx(own[i][1], abs=2e-9)) and got[i]["origin"] in ("file", "header")
            continue
        folder = up(p)
        while folder and folder not in speaks:
            folder = up(folder)
        best = max(speaks[folder]) if folder in speaks else None
        assert (got[i]["license"], got[i]["inherited_from"]) == ((best[1], best[2]) if best else (None, None)), (p, i)


def test_license_passages(spark):
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\nimport os\n"
    mit = "MIT License\n\nCopyright (c) 2020 A. Author. All rights reserved.\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice ..."
    files = {
        "spdx.c": ("/* SPDX-License-Identifier: MIT */ int x;", "MIT"),
        "spdx.py": ("#!x\n# SPDX-License-Identifier: Apache-2.0\nimport os", "Apache-2.0"),
        "spdx.x": ("// SPDX-License-Identifier: Foo-7.0", None),
        "two.py": ("# Released under the MIT License. Copyright 2020 The Project Authors and contributors to this repository.", "MIT"),
        "name.txt": ("MIT License", "MIT"),
        "gpl.py": (gpl, "GPL-3.0-or-later"),
        "gpl2.c": (gpl.replace("version 3", "version 2").replace("software:", "software;"), "GPL-2.0-or-later"),
        "apache.c": (" * Licensed under the Apache License,\n * Version 2.0 (the \"License\"); you may not use this file\n * except in compliance with the License.\n", "Apache-2.0"),
        "inline.md": ("Our tool, which many people like to use and extend, is free and released under the MIT License so that all may share what they make of it", "MIT"),
        "q/LICENSE": (mit, "MIT"),
        "lesser.c": ("// Licensed under the GNU Lesser General Public License v2.1", "LGPL-2.1-only"),
        "eclipse.java": ("This program and the accompanying materials\nare made available under the terms of the Eclipse Public License 2.0", "EPL-2.0"),
        "own.c": ("Copyright 2020 X. All rights reserved.", "LicenseRef-proprietary"),
        "prose.txt": ("She had a licence to sell fish. The copyright office was closed and nobody came.", None),
    }
    df = spark.createDataFrame([(p, t) for p, (t, _) in files.items()], "path string, text string")
    got = {r["path"]: r["license"] for r in licenses.scan(df, Scratch(spark)).collect()}
    assert got == {p: x for p, (_, x) in files.items()}


def test_pipeline_runs(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sf, columns = "/root/testdata/sf0.001", docs.columns
    scratch = Scratch(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, sf))
        assert name == "bpe" or docs.columns == columns, name
    assert docs.count() > 20


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, kept int, toxic int, copies int, m int, words string, _id int, _take int, size int, text_hash bigint, component int"


@pytest.fixture(scope="module")
def odd_corpus(spark, tmp_path_factory):
    """A folder with labels, and documents with nulls, empty and long texts, repeated rows, shared ids and clashing columns."""
    rng = random.Random(12)
    prose = lambda n: " ".join(f"word{rng.randrange(4000)}" for _ in range(n))
    base, long = prose(80), prose(60_000)
    near = base.split()
    near[40] = "changed"
    texts = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "too short"), (7, long), (8, prose(50)), (8, prose(50)), (9, base), (9, base), (None, prose(40)), (None, prose(40)), (10, prose(40) + ". You idiot, you moron, you worthless scum. You are trash, you clown")]
    texts += [(100 + i, prose(40)) for i in range(200)] + [(500 + i, prose(30) + ". You idiot. You moron, you stupid clown. Such worthless trash") for i in range(60)]
    rows = [(i, t, None if i == 8 else "en", None if i in (2, 8) else "s", None, *range(5), "w", *range(5)) for i, t in texts]
    folder = str(tmp_path_factory.mktemp("odd"))
    docs = spark.createDataFrame(rows, ODD)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(100 + i, 1, 0) for i in range(200)] + [(500 + i, 1, 1) for i in range(60)] + [(None, 1, 1), (3, None, None)]
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_pipeline_stages_on_odd_rows(spark, odd_corpus):
    import corpus_pipeline

    folder, rows = odd_corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages, scratch = dict(corpus_pipeline.STAGES), Scratch(spark)
    of = lambda df: collections.Counter((r["doc_id"], r["text"]) for r in df.collect())
    everything = collections.Counter((r[0], r[1]) for r in rows)
    for name in list(stages)[:4]:  # every stage on the odd rows themselves, and on none
        assert stages[name](spark, docs, folder).columns == docs.columns, name
        assert stages[name](spark, docs.limit(0), folder).count() == 0, name
    assert of(stages["quality_rules"](spark, docs, folder)) == collections.Counter({k: n for k, n in everything.items() if len((k[1] or "").split()) >= 20})
    toxic = of(stages["toxicity"](spark, docs, folder))
    assert toxic == collections.Counter({k: n for k, n in everything.items() if not (k[0] == 10 or (k[0] or 0) >= 500)})
    # Copies of one text under ids 1, 2, 3 and 9 leave id 1; both texts of id 8 stay, and all rows without an id or words.
    one = of(stages["near_duplicates"](spark, docs, folder))
    assert one == collections.Counter({k: 1 for k in everything if k[0] not in (2, 3, 9)})
    mixed = stages["mixing"](spark, docs, folder)
    taken = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.mix(docs, Scratch(spark)).groupBy("doc_id", "size").agg(F.sum("taken").alias("taken")).collect()}
    words = collections.Counter()
    for (i, t), n in of(mixed).items():
        words[i, len(WORD.findall(t))] += n * len(WORD.findall(t))
    assert {k: n for k, n in taken.items() if n} == dict(words)
    kept = scratch.keep(mixed)
    assert collections.Counter(r["n_tokens"] for r in stages["bpe"](spark, kept, folder).collect()) == collections.Counter(r["n_tokens"] for r in bpe.encode(mixed).collect())


def test_pipeline_without_labels(spark, odd_corpus, tmp_path):
    import corpus_pipeline

    folder, rows = odd_corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.clean(spark, docs, str(tmp_path)).count() == len(rows)
    assert corpus_pipeline.quality(spark, docs, str(tmp_path)).count() == sum(len((r[1] or "").split()) >= 20 for r in rows)


def test_mixed_deals_repeated_rows(spark, monkeypatch):
    """Rows of one id, source and size are numbered in parts; together they get all copies."""
    monkeypatch.setattr(mixing, "TOGETHER", 7)
    rows = [(1, "a b c d", "en", "hot", None, 1, "x", "y", "z")] * 50 + [(i, "w " * (i % 40 + 1), "en", f"s{i % 3}", None, 1, "x", "y", "z") for i in range(2, 200)]
    docs = spark.createDataFrame(rows, DOCS)
    want = collections.Counter()
    for r in mixing.mix(docs, Scratch(spark)).collect():
        want[r["doc_id"]] += r["taken"]
    got = collections.Counter()
    for r in mixing.mixed(docs, Scratch(spark)).collect():
        got[r["doc_id"]] += len(r["text"].split())
    assert got == +want and want[1] > 0
