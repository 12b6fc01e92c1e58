"""Each operator on small fixtures: against brute force, and with nulls, empty and repeated rows, extra columns, empty tables."""

import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from theoremlake.llm import content as C
from theoremlake.llm import crosssplit, knn, leak, neardup, packing, residue, splits, tokens

DECL = "decl_id long, name string, statement string, type_signature string, split string, id string, words string, sig int"


def declarations(n=120, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = rng.sample([f"w{j}" for j in range(400)], 20)
        if out and rng.random() < 0.6:
            words = out[rng.randrange(len(out))][8][:]
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(400)}"
        s = f"Lemma n{i} : forall (x{i} : T), " + " ".join(words)
        out.append((i, f"e{i % 40}_sym", s if i % 9 else None, " ".join(words), rng.choice(["train", "Training", "dev", " TEST ", None]), "clash", "clash", 1, words))
    out = [r[:8] for r in out]
    return [*out, (1000, None, None, None, "train", "c", "c", 1), (1001, "", " ", "\n", "test", "c", "c", 1), (1002, "e1", out[5][2], None, "test", "c", "c", 1)]


def likeness(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("hot_rows", [20_000, 3])
def test_near_duplicates(spark, hot_rows):
    rows = declarations()
    df = spark.createDataFrame(rows, DECL)
    members, links = neardup.near_duplicates(df, 0.7, hot_rows=hot_rows)
    got = {tuple(r) for r in neardup.pairs_of_rows(members, links).collect()}
    sets = {r[0]: set(C.word_set(c)) for r in rows if (c := C.content_of(r[2], r[3])[0])}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if likeness(sets[a], sets[b]) >= 0.7}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 50
    assert all(x.count() == 0 for x in neardup.near_duplicates(df.limit(0), 0.7))


@pytest.mark.parametrize("hot_rows", [20_000, 3])
def test_cross_split(spark, hot_rows):
    rows = declarations(seed=4)
    df = spark.createDataFrame(rows, DECL)
    got = {tuple(r) for r in crosssplit.overlapping_rows(*crosssplit.cross_split_overlaps(df, 0.7, 1, hot_rows=hot_rows)).collect()}
    sets, kind = {}, {}
    for r in rows:
        c, statement = C.content_of(r[2], r[3])
        if c and r[4]:
            sets[r[0]], kind[r[0]] = set(C.free_word_set(c, statement)), r[4].strip().lower().startswith("train")
    want = {(a, b) for a in sets for b in sets if kind[a] and not kind[b] and likeness(sets[a], sets[b]) >= 0.7}
    assert got == want and len(want) > 5
    assert crosssplit.cross_split_overlaps(df.limit(0))[1].count() == 0 and crosssplit.cross_split_overlaps(df)[1].count() >= 0


def test_canonical_content():
    a = C.canonical_content("Lemma foo  : forall (x y : T), x -> y /\\ exists z : T, z <= x.", True)
    assert a == C.canonical_content("Theorem bar' : ∀ (a b:T), a→b ∧ ∃ q : T, q ≤ a", True) == C.canonical_content("forall (u v : T), u -> v /\\ exists w : T, w <= u", False)
    assert a != C.canonical_content("Lemma foo : forall (x y : T), x -> x /\\ exists z : T, z <= x.", True)
    assert C.bound_variables("forall (a b' : T) (c := 1), exists d : T, fun e => f") == {"a", "b'", "d", "e"}


def test_entities():
    rel = {"sym", "is", "lemma"}
    names = {"A.veloRiad_x": "velo", "isZij": "zij", "LEMMA_Foo3": "foo", "sym_is": None, "": None, None: None, "VEL_cons": "vel", "_x'": "x"}
    assert {n: splits.entity_of(n, rel) for n in names} == names


def test_forest_and_splits(spark):
    rng = random.Random(6)
    edges = [(f"v{rng.randrange(60)}", f"v{rng.randrange(60)}") for _ in range(45)] + [("v1", None)] + [(f"p{i}", f"p{i + 1}") for i in range(20)]
    labels, forest = splits.spanning_forest(spark.createDataFrame(edges, "u string, v string"))
    group = {}
    for a, b in edges:
        if b and a != b:
            x, y = group.setdefault(a, {a}), group.setdefault(b, {b})
            if x is not y:
                x |= y
                group.update(dict.fromkeys(y, x))
    assert {r.vertex: r.root for r in labels.collect()} == {v: min(g) for v, g in group.items()}
    assert forest.count() == len(group) - len({id(g) for g in group.values()})
    assert splits.spanning_forest(spark.createDataFrame([], "u string, v string"))[0].count() == 0


def test_groups_stay_together(spark):
    rows = declarations()
    groups = splits.related_groups(spark.createDataFrame(rows, DECL), spark.createDataFrame([("sym",), (None,)], "word string")).cache()
    assert groups.count() == len(rows)
    kept = {r.decl_id: r.group_key for r in splits.grouped_rows(groups).collect()}
    assert kept[5] == kept[45] and 1000 not in kept
    out = splits.assign_splits(groups).collect()
    assert len(out) == len(rows) and all(len({r.split for r in g}) == 1 for g in _by(out, "group_id").values())
    assert splits.assign_splits(groups.limit(0)).count() == 0


def _by(rows, key):
    out = collections.defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 8))
    x = (centres[rng.integers(30, size=400)] + rng.normal(scale=0.1, size=(400, 8))).astype(np.float32)
    x[7] = x[8] = x[9] = x[10] = x[11] = x[12] = x[13]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0]), (904, [1.0] * 7 + [None])]
    df = spark.createDataFrame(rows, "point_id long, dense array<float>").withColumn("near", F.lit(1))
    got = collections.defaultdict(set)
    for r in knn.most_similar(df, 3, 8, forest=knn.Forest(trees=3, visits=5, leaf=60, min_sample=8)).collect():
        got[r.id].add(r.near)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    hits = sum(len(got[i] & set(np.argsort(-s[i])[:3].tolist())) for i in range(400) if not 7 <= i <= 13)
    assert hits >= 0.9 * 3 * 393 and all(len(v) == 3 for v in got.values()) and set(got) == set(range(400))
    assert got[7] == {8, 9, 10} and got[13] == {7, 8, 9}
    assert knn.most_similar(df.limit(0), 3, 8).count() == 0 and knn.most_similar(df.limit(1), 3, 8).count() == 0


def test_token_ids(spark):
    c = tokens.codec(tokens.DEFAULT_VOCABULARY)
    texts = [None, "", "a<|endoftext|>b", "x" * 900, " " * 500 + "y", "don't we'll " * 60, "é漢🙂" * 200, "word 12, " * 90, "word 12, " * 90]
    df = spark.createDataFrame(list(enumerate(texts)) + [(3, "x" * 900), (None, "z" * 300)], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = sorted(((r.doc_id, r.ids) for r in tokens.encode_texts(df, piece_chars=64).collect()), key=repr)
    want = sorted([(i, c.encode(t or "")) for i, t in enumerate(texts)] + [(3, c.encode("x" * 900)), (None, c.encode("z" * 300))], key=repr)
    assert got == want and tokens.encode_texts(df.limit(0)).count() == 0
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice(["a", "b", " ", "'", "s", "1", "!", "é", "\n", "ll", "the"]) for _ in range(rng.randint(1, 80)))
        n = rng.randint(1, 30)
        assert c.join_all([c.encode(t[i : i + n]) for i in range(0, len(t), n)]) == c.encode(t)


def best_fit(sizes, capacity):
    """Containers that best fit in decreasing order takes, item by item."""
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - s)
        else:
            rooms.append(capacity - s)
    return len(rooms)


def test_containers(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([3, 3, rng.randint(0, 30)])) for i in range(500)] + [(7, 3), (None, 5), (900, None), (901, 25)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long").withColumn("piece", F.lit("clash"))
    out = packing.pack(df, 10).collect()
    fill = collections.Counter()
    for r in out:
        assert (r.container_id is None) == (r.piece_size == 0)
        if r.container_id is not None:
            fill[r.container_id] += r.piece_size
    total = sum(n or 0 for _, n in rows)
    assert sum(fill.values()) == total and max(fill.values()) <= 10 and set(fill) == set(range(len(fill)))
    assert len(fill) <= best_fit([r.piece_size for r in out if r.piece_size], 10)
    assert sorted(r.piece_start for r in out if r.doc_id == 901) == [0, 10, 20] and packing.pack(df.limit(0), 10).count() == 0
    assert sum(m for _, m in packing.pack_histogram({6: 3, 5: 2, 4: 2, 3: 3}, 10)) == 5


def test_leaks(spark):
    item = "One two three four five six seven eight nine ten?"
    texts = [item, "x <b>TWO</b> three, four\nfi​ve six&nbsp;seven ｅｉｇｈｔ nine y", "one two three four five six seven x eight", "say small item now", None, "", "small  ITEM"]
    corpus = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)] + [("d", 0, item)], "corpus string, id long, text string").withColumn("likeness", F.lit(0))
    items = spark.createDataFrame([(1, item), (2, "small item"), (3, None), (4, "?!"), (None, item)], "id long, text string")
    for a_pass in (200_000, 2):
        got = {(r.record_id, r.item_id) for r in leak.leaked_items(corpus, items, passages_a_pass=a_pass).where("same").collect()}
        assert got == {(0, 1), (1, 1), (3, 2), (6, 2)}
    assert leak.leaked_items(corpus, items.limit(0)).count() == 0 and leak.leaked_items(corpus.limit(0), items).count() == 0
    h = np.array([5, 9, 5, 7], np.uint64)
    assert (leak.simhashes(h, 2)[0], len(leak.simhashes(h, 5))) == (np.uint64(5 & 9), 0)


def test_residue(spark):
    cases = ["{{ title }}", "Maintained by ${author} since %(date)s.", "Home | Search\n404 Not Found\nPlease try again in a few minutes.", "Please enable JavaScript to view this page.", "Lorem ipsum dolor sit amet consectetur elit.", "A real sentence about rings. File {{ path }}, line [[count]]: <name>.", "File null, line undefined: null."]
    real = ["Thanks, it works!", 'Notation "{{ x | P }}" := (foo (fun x => P)).', "The template replaces `{name}` by the name.", "If the server says 503 Service Unavailable, wait for the nightly run.", "When f is undefined on null sets we return None.", "# Rings.Foo", "", None, "  \n", "In C, %s and __LINE__ end up inside the message."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)] + [(100 + i, t) for i, t in enumerate(real)], "doc_id long, text string").withColumn("label", F.lit("clash"))
    assert sorted(r.doc_id for r in residue.residue_pages(df).collect()) == list(range(len(cases)))
    assert residue.residue_pages(df.limit(0)).count() == 0
