import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from findwell.llm import blocks, near_copies, terms
from findwell.llm.fuse_scores import fused_ranking, rank_within
from findwell.llm.leaks import find_leaks, remove_leaks, search_shard, Items, words_of
from findwell.llm.neighbours import Forest, similar_vectors
from findwell.llm.pairs import pairs_within
from findwell.llm.spans import Hasher, shared_parts, shared_stretches, sharing_pairs, window_ranges
from findwell.llm.encode import MergeTable, encode_texts, replay, tokenizer_path

WORDS = [f"{a}{b}" for a in "ba be bi bo bu da de di".split() for b in "ka ke ki ko ku ma me mi mo".split()]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def stored(spark, rows):
    """(id, title, content) with two times and columns named like the operators' own."""
    data = [(i, t, c, None, None, "x", 1, 2) for i, t, c in rows]
    return spark.createDataFrame(data, "id string, title string, content string, updated_at timestamp, created_at timestamp, key string, cls int, block int")


def test_counts_and_hashes_are_packed_without_loss():
    counts = np.array([1, 254, 255, 256, 10**12], dtype=np.int64)
    assert (blocks.unpack_counts(blocks.pack_counts(counts), 5) == counts).all()
    tokens = np.array([1 << 16, (1 << 64) - (1 << 16), 0], dtype=np.uint64)
    assert (blocks.lengthen(blocks.shorten(tokens)) == tokens).all()
    for some in (np.sort(tokens), tokens[:0], np.arange(1000, dtype=np.uint64) << np.uint64(50)):
        assert (blocks.unpack_sorted(blocks.pack_sorted(some)) == some).all()
    for marks in (tokens, np.repeat(tokens, 50), tokens[:0], np.arange(100_000, dtype=np.uint64) << np.uint64(16)):
        assert (blocks.unpack_marks(blocks.pack_marks(marks)) == marks).all()


# --- near copies


def shingles(text, k):
    w = [x.lower() for x in re.findall(r"[^\W_]+", text)]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}, len(w)


@pytest.mark.parametrize("rare, budget, spare, block", [(16, 4, 64, 4096), (1, 4, 64, 3), (0, 0, 0, 4096), (0, 0, 0, 2), (1, 1, 0, 4096), (1, 10**6, 0, 5)])
@pytest.mark.parametrize("shingle, threshold", [(3, 0.6), (5, 0.8)])
def test_near_copies_equal_all_pairs(spark, rare, budget, spare, block, shingle, threshold):
    r = random.Random(rare * 31 + shingle)
    rows = []
    for g in range(25):
        base = prose(r, r.choice([22, 30, 60, 150])).split()
        for k in range(r.choice([1, 1, 2, 4])):
            w = list(base)
            for _ in range(r.randrange(0, 6)):
                at = r.randrange(len(w))
                w[at : at + 1] = r.choice([[], [r.choice(WORDS)], [w[at], r.choice(WORDS)]])
            rows.append((f"{g}-{k}", r.choice(["", None, "a title"]), " ".join(w)))
    boiler = "the same old words again and again here " * 3
    rows += [(f"b{k}", None, boiler + r.choice(WORDS)) for k in range(12)] + [(f"x{k}", "X", boiler) for k in range(5)]
    rows += [("null", None, None), ("tiny", None, "a b c"), ("same", None, "word " * 25), ("same2", None, "Word, " * 30), ("punct", "", "!!! " * 40)]
    df = stored(spark, rows)
    got = {(p["id_a"], p["id_b"]) for p in near_copies.near_copy_pairs(df, shingle=shingle, threshold=threshold, rare=rare, budget=budget, spare=spare, block=block).collect()}
    sets = {i: s for i, t, c in rows for s, n in [shingles(f"{t or ''} {c or ''}", shingle)] if n >= 20}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}
    assert got == want


def test_near_copies_of_nothing(spark):
    members, pairs = near_copies.near_copies(stored(spark, []))
    assert members.count() == 0 and pairs.count() == 0


def near_copies_by_hand(rows, shingle, threshold):
    sets = {i: shingles(f"{t or ''} {c or ''}", shingle)[0] for i, t, c in rows}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


def test_a_long_passage_in_many_records_makes_few_keys(spark, monkeypatch):
    """Records that share a passage, more than half of them, but aren't similar; and a few that are."""
    r = random.Random(12)
    passage = prose(r, 400)
    rows = [(f"{k:04d}", None, f"{passage} {prose(r, 120 + k % 40)}") for k in range(300)]
    rows += [(f"n{k}", None, rows[k][2] + " with two more") for k in range(5)]
    written = {}

    def keep(df, name):
        written[name] = materialize(df, name)
        return written[name]

    materialize = near_copies.materialize
    monkeypatch.setattr(near_copies, "materialize", keep)
    got = {(p["id_a"], p["id_b"]) for p in near_copies.near_copy_pairs(stored(spark, rows)).collect()}
    assert got == near_copies_by_hand(rows, 5, 0.8) and len(got) >= 5
    assert written["keys"].where("kind > 0").count() <= 4 * len(rows)


def test_records_of_common_sequences_alone_stay_within_the_budget(spark, monkeypatch):
    """Long records drawn from the same phrases: every sequence is common and no two have the same holders."""
    r = random.Random(13)
    phrases = [prose(r, 12) for _ in range(80)]
    rows = []
    for k in range(60):
        mine = [p for p in phrases if r.random() < 0.6]
        rows.append((f"{k:03d}", None, " ".join(mine)))
        if k % 10 == 0:
            rows.append((f"{k:03d}x", None, " ".join(mine[:-1])))
    written = {}

    def keep(df, name):
        written[name] = materialize(df, name)
        return written[name]

    materialize = near_copies.materialize
    monkeypatch.setattr(near_copies, "materialize", keep)
    got = {(p["id_a"], p["id_b"]) for p in near_copies.near_copy_pairs(stored(spark, rows), rare=2, budget=1, spare=0).collect()}
    assert got == near_copies_by_hand(rows, 5, 0.8) and len(got) >= 6
    each = written["keys"].where("kind > 0").groupBy("cls").agg(F.count("*").alias("k"), F.max("n").alias("n")).collect()
    assert all(x["k"] <= 3 * x["n"] for x in each)


def test_keys_of_common_tokens_are_few_and_candidates_are_verified_once(spark, monkeypatch):
    """Sentences of a few patterns, as in a large collection: nearly every sequence is common, and few pairs are similar."""
    r = random.Random(14)
    rows = [(f"{k:03d}", None, " ".join(f"the {r.choice(WORDS[:60])} of {r.choice(WORDS[:60])} may" for _ in range(40))) for k in range(250)]
    rows += [(f"{k:03d}x", None, rows[k][2].replace("may", "must", 1)) for k in range(8)]
    written = {}

    def keep(df, name):
        written.setdefault(name, []).append(materialize(df, name))
        return written[name][-1]

    materialize = near_copies.materialize
    monkeypatch.setattr(near_copies, "materialize", keep)
    got = {(p["id_a"], p["id_b"]) for p in near_copies.near_copy_pairs(stored(spark, rows), shingle=3, threshold=0.6).collect()}
    sizes = [len(shingles(c, 3)[0]) for _, _, c in rows]
    assert got == near_copies_by_hand(rows, 3, 0.6) and len(got) >= 8
    keys = sum(int(np.frombuffer(x["tokens"], dtype="<u4", count=1)[0]) for x in written["keys"][0].where("kind = -1").collect())
    assert keys + written["keys"][0].where("kind > 0").count() <= 4 * sum(sizes)
    assert written["pairs"][0].count() <= 2 * len(got) + 8
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")


def test_sketches_never_tell_of_more_than_is_missing():
    r = np.random.default_rng(5)
    for n, m in ((20, 30), (90, 200), (700, 500), (3, 3)):
        common, x, y = (r.integers(1, 1 << 48, k).astype(np.uint64) << np.uint64(16) for k in (n // 2, n - n // 2, m - n // 2))
        p, q = near_copies.missing(near_copies.sketch(np.concatenate([common, x]), n), near_copies.sketch(np.concatenate([common, y]), m))
        assert p <= len(x) and q <= len(y) and (n < 9 or p > len(x) / 4 and q > len(y) / 4)
        same = near_copies.sketch(common, n)
        assert near_copies.missing(same, same) == (0, 0)


# --- terms


def test_term_weights_equal_those_by_hand(spark):
    r = random.Random(3)
    rows = [(f"d{k}", r.choice([None, "Title x1 ab"]), prose(r, r.randrange(1, 60)) + " <b>Ünï</b> a_b x2y") for k in range(40)] + [("null", None, None), ("blank", "", "  "), (None, "t", "lost words")]
    got = {(w["id"], w["term"]): (w["tf"], w["df"], w["weight"]) for w in terms.term_weights(stored(spark, rows)).collect()}
    bags = {i: Counter(w.lower() for w in re.findall(r"[^\W_]+", f"{t or ''} {c or ''}") if len(w) >= 3 and w.isalpha()) for i, t, c in rows if i}
    df = Counter(w for b in bags.values() for w in b)
    n, average = len(bags), sum(sum(b.values()) for b in bags.values()) / len(bags)
    want = {}
    for i, b in bags.items():
        for w, tf in b.items():
            idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
            want[i, w] = (tf, df[w], round(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sum(b.values()) / average)), 6))
    assert got.keys() == want.keys()
    assert all(got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 2e-6 for k in want)
    best = terms.term_weights(stored(spark, rows), k1=float("inf"), idf="plain", least_held=2, best_held=(2, 8)).collect()
    plain = {(i, w): round(tf * math.log(n / df[w]), 6) for i, b in bags.items() for w, tf in b.items() if df[w] > 1}
    tops = {i: max((x for (j, _), x in plain.items() if j == i), default=None) for i in bags}
    assert {(b["id"], b["term"]) for b in best} == {(i, w) for (i, w), x in plain.items() if x == tops[i] and 2 <= df[w] <= 8}
    assert terms.term_weights(stored(spark, [])).count() == 0


# --- scores


SCHEMA = "g bigint, item string, a double, b double, rank_a int, __n int"


def test_ranks_are_the_same_however_groups_are_held(spark):
    r = random.Random(5)
    data = [(g, f"i{k}", r.choice([None, 1.0, 2.0, r.random()]), r.choice([None, -1.0, r.random()])) for g in range(4) for k in range([1, 3, 50, 400][g])]
    df = spark.createDataFrame(data, "g bigint, item string, a double, b double")
    plain = {tuple(x) for x in rank_within(df, "g", ["a", "b"]).collect()}
    split = {tuple(x) for x in rank_within(df, "g", ["a", "b"], hot_rows=2).collect()}
    assert plain == split
    for g, item, a, b, ra, rb in plain:
        mine = [x for x in data if x[0] == g]
        below = sum((x[2] is None and a is not None) or (x[2] is not None and a is not None and x[2] < a) for x in mine)
        assert ra == (below / (len(mine) - 1) if len(mine) > 1 else 0)


def test_first_places(spark):
    data = [
        (1, "x", 10.0, 0.9), (1, "x", 10.0, 0.9), (1, "y", 1000.0, None), (1, "z", 5.0, 0.1),  # repeated hit, missing score
        (2, "p", None, 0.2), (2, "q", None, 0.3),  # a score missing from the whole group
        (3, "tie2", 1.0, 1.0), (3, "tie1", 1.0, 1.0), (4, "only", None, None), (None, "lost", 1.0, 1.0), (5, None, 1.0, 1.0), (6, "nan", float("nan"), 0.1), (6, "ok", 0.1, 0.1),
    ]
    df = spark.createDataFrame([(*d, 1, 2) for d in data], SCHEMA)
    fused = fused_ranking(df, "g", "item", ["a", "b"])
    best = fused.groupBy("g").agg(F.min(F.struct((-F.col("fused")).alias("f"), "item")).alias("b")).select("g", "b.item")
    assert dict(map(tuple, best.collect())) == {1: "x", 2: "q", 3: "tie1", 4: "only", 6: "ok"}
    assert fused_ranking(df.limit(0), "g", "item", ["a", "b"]).count() == 0
    down = fused_ranking(df.where("g = 2"), "g", "item", ["a", "b"], directions=[1, -1]).orderBy(F.desc("fused")).first()
    assert down["item"] == "p"


# --- vectors


def test_neighbours_against_brute_force(spark):
    g = np.random.default_rng(1)
    base = g.standard_normal((300, 64))
    near = base[:60] + 0.15 * g.standard_normal((60, 64))
    x = np.concatenate([base, near, base[:5]]).astype(np.float32)
    ids = [f"v{k:04d}" for k in range(len(x))]
    bad = [("null", None), ("empty", []), ("short", [1.0]), ("zero", [0.0] * 64), ("nan", [float("nan")] * 64), ("inf", [float("inf")] * 64), (None, [1.0] * 64), ("hole", [None] + [1.0] * 63)]
    rows = [(i, [float(y) for y in v]) for i, v in zip(ids, x)] + bad
    rows += rows[:7]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "id string, e array<float>, rid int, leaf int")
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    want = {(ids[i], ids[j]) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= 0.9}
    got = similar_vectors(df, "id", "e", threshold=0.9).collect()
    found = {(r["id_a"], r["id_b"]) for r in got}
    assert found <= want and len(found) >= 0.95 * len(want) and len(found) == len(got)
    assert all(abs(r["score"] - s[ids.index(r["id_a"]), ids.index(r["id_b"])]) < 1e-5 for r in got)
    top = similar_vectors(df, "id", "e", top=3, asking=F.col("id").isin(ids[:20]), probes=40).collect()
    hit = sum(r["id_b"] in {ids[j] for j in np.argsort(-s[ids.index(r["id_a"])])[:4]} for r in top)
    assert len(top) == 60 and hit >= 54
    exact = {(r["id_a"], r["id_b"]) for r in similar_vectors(df, "id", "e", threshold=0.9, probes=None).collect()}
    assert exact == want
    order = {i: sorted((-s[ids.index(i), j], ids[j]) for j in range(len(x)) if ids[j] != i)[:3] for i in ids[60:80]}
    top = similar_vectors(df, "id", "e", top=3, asking=F.col("id").isin(ids[60:80]), probes=None).collect()
    assert {(r["id_a"], r["id_b"]) for r in top} == {(i, b) for i, best in order.items() for _, b in best}
    assert similar_vectors(df.limit(0), "id", "e", threshold=0.9).count() == 0
    with pytest.raises(ValueError):
        similar_vectors(df, "id", "e")


def test_leaves_stay_small_at_any_size_and_the_queue_takes_the_best_first():
    g = np.random.default_rng(2)
    x = g.standard_normal((20_000, 64)).astype(np.float32)
    x[:6000] = x[0] + 0.2 * x[:6000]  # a dense third
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = Forest(x[g.permutation(len(x))[:1024]], len(x), leaf=32, target=64)
    assert forest.fitted == 5 and forest.depth > 5
    own = np.concatenate([forest.search(x[k : k + 2000], forest.trees) for k in range(0, len(x), 2000)])
    for t in range(forest.trees):
        sizes = np.unique(own[:, t], return_counts=True)[1]
        assert (own[:, t] >> 52 == t).all() and sizes.max() <= 64 * 32
    some, probes = x[:50], 12
    found = forest.search(some, probes)
    assert (found[:, : forest.trees] == own[:50]).all()
    for q, leaves in zip(some, found):  # against every leaf of every tree, by the margins of its path

        def priority(leaf):
            tree, node, best = leaf >> 52, leaf & (1 << 52) - 1, np.inf
            for level in range(int(node).bit_length() - 1):
                at = node >> (int(node).bit_length() - 1 - level)
                margin, _ = forest._margins(q[None], np.array([tree]), np.array([at]), np.array([level]))
                up = node >> (int(node).bit_length() - 2 - level) & 1
                best = min(best, margin[0] if up else -margin[0])
            return best

        every = sorted((priority(leaf) for leaf in set(own.ravel().tolist()) | set(leaves.tolist())), reverse=True)
        got = sorted((priority(leaf) for leaf in leaves.tolist()), reverse=True)
        assert len(set(leaves.tolist())) == probes and np.allclose(got, every[:probes], atol=1e-5)


# --- tokenizer


def test_ids_equal_the_tokenizer_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    r = random.Random(2)
    texts = [None, "", " ", "\n\n  \t", "<|endoftext|> x", "Hello world's 123 😀 für", "a" * 3000, "日本語テキスト", "\x00\x7f\u2028", " lead", "trail "]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x500), 32, 0x1F600])) for _ in range(60)) for _ in range(200)]
    df = spark.createDataFrame([(k, x, "c") for k, x in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {x["doc_id"]: x["ids"] for x in encode_texts(df, "text", ["doc_id"]).collect()}
    assert got == {k: t.encode(x or "", add_special_tokens=False).ids for k, x in enumerate(texts)}
    assert encode_texts(df.limit(0), "text", ["doc_id"]).count() == 0
    table = MergeTable(tokenizer_path())
    together = replay([b"aaaa", b" the", b"", b"aaaa"], table)
    assert together == [replay([w], table)[0] for w in (b"aaaa", b" the", b"", b"aaaa")]


# --- leaks


def leaks_by_hand(docs, items, least):
    out = set()
    for d, text in docs:
        w = words_of(text)
        for i, item in items:
            v = words_of(item)
            n = min(least, len(v))
            if n and d is not None and any(w[a : a + n] == v[b : b + n] for b in range(len(v) - n + 1) for a in range(len(w) - n + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("chars", [10**7, 50])
def test_leaks_against_brute_force(spark, chars):
    r = random.Random(4)
    items = [(k, prose(r, r.choice([3, 8, 12, 30]))) for k in range(25)] + [(90, None), (91, ""), (92, "!?"), (93, "Ba-ka BE ke"), (0, None)]
    docs = []
    for k in range(80):
        w = prose(r, 40)
        if k % 3 == 0:
            v = words_of(r.choice(items[:25])[1])
            a = r.randrange(0, max(1, len(v) - 11))
            w = w + " " + ", ".join(x.upper() for x in v[a : a + r.choice([11, 12, 13, 40])]) + " " + prose(r, 3)
        docs.append((k, w))
    docs += [(200, None), (201, ""), (202, "ba ka be ke"), (202, "ba ka be ke"), (None, "ba ka be ke"), (203, "ba ka be")]
    dd = spark.createDataFrame([(a, b, 1, "x") for a, b in docs], "doc_id bigint, text string, item_id int, k string")
    ii = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id bigint, text string, doc_id int")
    got = find_leaks(dd, ii, block_chars=chars)
    rows = got.collect()
    found = {(x["doc_id"], x["item_id"]) for x in rows}
    assert found == leaks_by_hand(docs, items, 12) and len(rows) == len(found)
    kept = {x["doc_id"] for x in remove_leaks(dd, got).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in found}
    assert find_leaks(dd, ii.limit(0)).count() == 0 and find_leaks(dd.limit(0), ii).count() == 0


def test_longest_match():
    items = Items([(7, "a b c d e f g h")], 3)
    number = items.vocabulary.get
    doc, item, longest = search_shard([[number(w, 0) for w in t.split()] for t in ("x a b c d y e f g h", "a b", "c d e")], items)
    assert sorted(zip(doc.tolist(), item.tolist(), longest.tolist())) == [(0, 7, 4), (0, 7, 4), (2, 7, 3)]


# --- spans


def spans_by_hand(docs, least):
    out = {}
    docs = [(k, t) for k, t in docs if t and len(t) >= least and k is not None]
    grams = {}
    for k, t in docs:
        for p in range(len(t) - least + 1):
            grams.setdefault(t[p : p + least], set()).add(k)
    for g in grams.values():
        for a in g:
            for b in g:
                if a < b:
                    out[a, b] = True
    return set(out)


@pytest.mark.parametrize("functions, gram", [(3, 60), (1, 60), (2, 10), (4, 99)])
def test_spans_against_brute_force(spark, functions, gram):
    r = random.Random(6)
    shared = [prose(r, 40)[:n] for n in (95, 99, 100, 101, 150, 180)]
    docs = []
    for k in range(60):
        parts = [prose(r, r.randrange(1, 30)) for _ in range(2)] + r.sample(shared, r.choice([0, 1, 1, 2]))
        r.shuffle(parts)
        docs.append((k, "😀|".join(parts)))
    docs += [(70, None), (71, ""), (72, "-" * 400), (73, "-" * 150 + "x" * 20), (74, "=-" * 120), (75, "y" + "=-" * 70), (76, docs[0][1]), (77, docs[0][1]), (77, docs[0][1]), (None, docs[0][1]), (78, "z" * 99), (79, "z" * 99)]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in docs], "doc_id bigint, text string, cls int, sig int")
    sizes = {"least": 100, "gram": gram, "functions": functions}
    got = sharing_pairs(df, "doc_id", "text", **sizes).collect()
    want = spans_by_hand(docs, 100)
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    texts = dict(docs)
    parts = {x["key"]: (x["n_chars"], x["shared_chars"]) for x in shared_parts(df, "doc_id", "text", **sizes).collect()}
    assert set(parts) == {k for p in want for k in p}
    others = {k: {t[p : p + 100] for j, t in docs if j != k and j is not None and t for p in range(len(t) - 99)} for k in parts}
    for k, (n, part) in parts.items():
        covered = set()
        for p in range(len(texts[k]) - 99):
            if texts[k][p : p + 100] in others[k]:
                covered |= set(range(p, p + 100))
        assert (n, part) == (len(texts[k]), len(covered))
    assert sharing_pairs(df.limit(0), "doc_id", "text").count() == 0


def test_pieces_of_periodic_texts_at_every_phase(spark):
    r = random.Random(8)
    docs = []
    for period in (2, 40, 80):
        unit = "".join(r.choice("abcdefgh") for _ in range(period))
        pieces = [(1000, 0), *[(n, r.randrange(period)) for n in (300, 303, 303, 303, 300 + period)]]
        docs += [(unit * 700)[at : at + n] for n, at in pieces]
        docs += ["[" + (unit * 700)[:400] + "] tail", "(" + (unit * 700)[:400 + 3 * period] + "] tail, longer"]
    docs = [(k, t) for k, t in enumerate(docs)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got, want = [tuple(x) for x in sharing_pairs(df, "doc_id", "text").collect()], spans_by_hand(docs, 300)
    assert set(got) == want and len(got) == len(want)
    parts = {x["key"]: x["shared_chars"] for x in shared_parts(df, "doc_id", "text").collect()}
    for k, t in docs:
        others = {u[p : p + 300] for j, u in docs if j != k for p in range(len(u) - 299)}
        covered = {p + i for p in range(len(t) - 299) if t[p : p + 300] in others for i in range(300)}
        assert parts.get(k, 0) == len(covered)


def test_windows_are_those_of_the_cartesian_tree():
    r = random.Random(9)
    texts = ["".join(r.choice("ab") for _ in range(n)) for n in (40, 12, 77)] + ["a" * 30]
    least, gram = 12, 5
    text, low, high, sig = window_ranges(texts, Hasher(), least, gram, range(2))
    for j in range(2):
        for k, t in enumerate(texts):
            mine = sorted((a, b, s) for o, a, b, s in zip(text.tolist(), low.tolist(), high.tolist(), sig.tolist()) if o == k and s & 3 == j)
            assert [x for a, b, _ in mine for x in range(a, b + 1)] == list(range(len(t) - least + 1))  # each stretch once
            tokens = {t[i : i + gram] for i in range(len(t) - gram + 1)}
            least_of = {}
            for a, b, s in mine:
                for x in range(a, b + 1):
                    least_of[x] = s
            known = {}  # equal stretches have equal signatures, within and between texts
            for x, s in least_of.items():
                assert known.setdefault(t[x : x + least], s) == s
            assert len({s for *_, s in mine}) <= len(tokens)


def test_a_passage_in_very_many_texts_costs_each_of_them_the_same(spark):
    r = random.Random(10)
    footer = prose(r, 120)
    docs = [(k, f"{prose(r, 70)} {footer}") for k in range(400)] + [(900, footer)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    members, groups, stretches = shared_stretches(df, "doc_id", "text")
    each = {x["cls"]: x["n"] for x in stretches.groupBy("cls").agg(F.count("*").alias("n")).collect()}
    assert len(each) == 401 and max(each.values()) <= len(footer) - 299 + 40  # some agree in the letters before it
    assert groups.count() <= 20 * 401
    parts = {x["key"]: x["shared_chars"] for x in shared_parts(df, "doc_id", "text").collect()}
    assert len(parts) == 401 and all(len(footer) <= n <= len(footer) + 40 for n in parts.values())
    assert sharing_pairs(df, "doc_id", "text").count() == 401 * 400 // 2


def test_pairs_within_groups_in_blocks(spark):
    rows = [("hot", k) for k in range(57)] + [("two", 3), ("two", 100), ("one", 5), (None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "g string, x int")
    want = {(a, b) for a in range(57) for b in range(a + 1, 57)} | {(3, 100)}
    for block in (1, 7, 57, 4096):
        got = [tuple(p) for p in pairs_within(df, ["g"], "x", block).collect()]
        assert set(got) == want and len(got) == len(want)


def test_many_equal_vectors_are_one_in_the_search(spark):
    g = np.random.default_rng(3)
    x = g.standard_normal((40, 64)).astype(np.float32)
    rows = [(f"c{k:03d}", [float(y) for y in x[0]]) for k in range(60)] + [(f"o{k:03d}", [float(y) for y in v]) for k, v in enumerate(x[1:])]
    df = spark.createDataFrame(rows, "id string, e array<float>")
    pairs = {(r["id_a"], r["id_b"]) for r in similar_vectors(df, "id", "e", threshold=0.9999).collect()}
    assert pairs == {(f"c{i:03d}", f"c{j:03d}") for i in range(60) for j in range(i + 1, 60)}
    top = similar_vectors(df, "id", "e", top=5, asking=F.col("id").isin("c000", "c030", "o001")).collect()
    got = {i: [r["id_b"] for r in sorted(top, key=lambda r: r["rank"]) if r["id_a"] == i] for i in ("c000", "c030", "o001")}
    assert got["c000"] == [f"c{k:03d}" for k in range(1, 6)] and got["c030"] == [f"c{k:03d}" for k in range(5)] and len(got["o001"]) == 5
