"""Prefix trees, credential grammars and centroid tables against plain versions."""

import hashlib
import random
import re
import string
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentiloom.llm import centroids, grammars, radix, secrets, tries

# --- Radix trees ---------------------------------------------------------------


@pytest.mark.parametrize("letters", [3, 14, 40, 256])
def test_radix_tree_counts_prefixes(letters):
    rng = random.Random(letters)
    keys = [bytes(rng.randrange(letters) for _ in range(rng.randint(0, 5))) for _ in range(3000)]
    tree = radix.Tree(lambda a, b: a + b)
    for i, k in enumerate(keys):
        tree.insert(k, i, 1)
    got = {}
    for row, begin, end, n in tree.nodes():
        for length in range(begin + 1, end + 1):
            assert keys[row][:length] not in got
            got[keys[row][:length]] = n
    want = defaultdict(int)
    for k in keys:
        for length in range(len(k) + 1):
            want[k[:length]] += 1
    assert got == want


def test_layouts_grow():
    kids = radix.Sorted(4)
    seen = []
    for b in random.Random(1).sample(range(256), 256):
        kids = kids.put(b, radix.Node(b"", b))
        seen.append((type(kids).__name__, getattr(kids, "size", 0)))
    assert [seen[i] for i in (3, 4, 15, 16, 47, 48, 255)] == [
        ("Sorted", 4), ("Sorted", 16), ("Sorted", 16), ("Indexed", 0), ("Indexed", 0), ("Full", 0), ("Full", 0)
    ]
    assert [b for b, _ in kids.items()] == list(range(256)) and all(kids.get(b).row == b for b in range(256))


# --- Prefix tree of conversations -------------------------------------------------


def plain_tree(rows, family=100, most=6):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, role, mark, text))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    nodes = {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % most
        base = c - (abs(c) % family) * (1 if c >= 0 else -1)
        path = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            node = nodes.setdefault(tuple(path[:d]), dict(conv=c, n=0, ends=[], kids=set()))
            node["n"] += 1
            if d == len(path):
                node["ends"].append(str(c))
            else:
                node["kids"].add(path[d])
    out = []
    for path, n in nodes.items():
        below = [(q, m) for q, m in nodes.items() if q[: len(path)] == path]
        out.append(
            (
                n["conv"], len(path), nodes[path[:-1]]["conv"] if path else None, n["n"], len(n["kids"]),
                sum(not m["kids"] for _, m in below), sum((m["n"] - 1) * len(q[-1][1]) for q, m in below if q),
                hashlib.sha256(",".join(n["ends"]).encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def spark_tree(df, **options):
    nodes, ends = tries.prefix_tree(df, **options)
    rows = nodes.join(tries.digests(ends), ["k1", "k2"], "left").collect()
    empty = hashlib.sha256(b"").hexdigest()
    return sorted(
        (
            (r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256 or empty)
            for r in rows
        ),
        key=repr,
    )


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("size", [2, 256])
def test_prefix_tree(spark, size):
    rng = random.Random(7)
    rows = []
    for c in [*range(0, 30), *range(195, 225), -3, -100, -150, 1000]:
        for t in range(rng.choice([1, 2, 4, 7, 11])):
            rows.append((c, rng.choice([t, t, None, 3]), rng.choice(["user", "user", None, ""]), rng.choice(["a", "bb", "", None, "\U0001f600x"])))
    rows += [(5000, t, "user", "same") for t in range(40)] + [(c, t, "user", "same") for c in range(5100, 5130) for t in range(40 - c % 3)]
    rows += [(None, 1, "user", "nobody"), (5000, 39, "user", "same"), (12, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("x")).withColumn("k1", F.lit(1)).repartition(5)
    assert spark_tree(df, size=size) == plain_tree(rows)


def test_long_conversation_is_cut(spark):
    rows = [(c, t, "user", f"{t % 7}") for c in (0, 1, 150) for t in range(1500 - c)] + [(2, t, "user", f"{t % 7}") for t in range(1500)]
    rows += [(150, 2000, "user", "last")]
    got = spark_tree(spark.createDataFrame(rows, SCHEMA), size=16)
    own = {c: [(r, x) for k, _, r, x in rows if k == c] for c in (0, 1, 2, 150)}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    paths = {c: tuple(own.get(c - c % 100, [])[: h[c]] + own[c][h[c] :]) for c in own}
    assert len(got) == len({p[:d] for p in paths.values() for d in range(len(p) + 1)})
    assert sum(g[3] for g in got) == sum(len(p) + 1 for p in paths.values())


def test_empty_conversations(spark):
    assert spark_tree(spark.createDataFrame([], SCHEMA)) == []
    bare = [c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 0][:2]
    rows = [(c, 0, "user", "gone") for c in bare]  # no conversation 0, and the only turn goes
    assert spark_tree(spark.createDataFrame(rows, SCHEMA)) == plain_tree(rows)


# --- Grammars and secrets --------------------------------------------------------


def test_grammar_learns_formats():
    rng = random.Random(3)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(300)]
    keys = ["AKIA" + "".join(rng.choice(string.ascii_uppercase + string.digits) for _ in range(16)) for _ in range(300)]
    for own, other in ((hexes, keys), (keys, hexes)):
        automaton = grammars.infer(own[:200])
        assert len(automaton.log) < 20
        assert min(automaton.likelihoods(own[200:])) > max(automaton.likelihoods(other))
    probe = ["AKIA", "a" * 5, "", "Z" * 300, keys[0] * 20]
    both = [automaton.likelihood(grammars.CODE[np.frombuffer(s.encode(), np.uint8)]) for s in probe]
    assert np.allclose(automaton.likelihoods(probe), both)
    assert np.allclose(np.exp(automaton.log).sum(axis=1), 1)


def test_states_merge_only_if_compatible():
    repeats = [int(n) for n in np.random.default_rng(1).geometric(0.3, 500)]
    tree = grammars.PrefixTree(["ab" * n for n in repeats])
    kept = tree.merge(0.05)
    assert len(kept) == 3 and sum(tree.ends[k] for k in kept) == 500  # before, between, after
    assert sum(n for k in kept for n in tree.passed[k].values()) == 2 * sum(repeats)


def plain_secrets(text):
    rules = [
        ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
        ("access", "AKIA[A-Z0-9]+", 0, 16),
        ("hex", "[0-9a-f]+", 0, 32),
    ]
    found = [(m.start(), k, name, m.end()) for k, (name, p, g, least) in enumerate(rules) for m in re.finditer(p, text) if len(m[g]) >= least]
    return [(k, a, b) for a, k, _, b in sorted(found)]


def secret_rows():
    rng = random.Random(11)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    words = ["understanding", "information", "pass:word", "2021-04-05", "4111111111111111", "192.168.100.200", "IMPORTANT-NOTE", "secret", "token ="]
    words += ["".join(rng.choice(["an", "the", "ing", "tion", "er", "est"]) for _ in range(5)) for _ in range(300)]
    words += [str(rng.randrange(10**15, 10**16)) for _ in range(600)]
    rows = []
    for i in range(300):
        text = " ".join(rng.choices(words, k=60))
        if i % 3 == 0:
            text += f' api_key="{pick("0123456789abcdef", 24)}" ' + rng.choice(words)
        if i % 5 == 0:
            text += " (" + "AKIA" + pick(string.ascii_uppercase + string.digits, 16) + ") \U0001f600 "
        rows.append((i, text))
    planted = {1000 + i: pick("0123456789abcdef", 24) for i in range(3)}
    rows += [(i, f"\U0001f600 the key {p}, to be kept safe") for i, p in planted.items()]
    edge = "token=short secret=token:abcdefghijk PASSWORD : 'x.y-z/12345' AKIAAKIA AKIA" + "Q" * 40 + " " + "f" * 31 + " " + "0" * 64 + " tokentoken==12345678="
    rows += [(2000, edge), (2001, None), (2002, ""), (2003, "x" * 300_000 + " password=" + "y" * 300_000), (None, edge), (2000, edge)]
    return rows, planted


def test_secrets(spark):
    rows, planted = secret_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", F.lit("b")).withColumn("row", F.lit(1)).repartition(4)
    got = secrets.find(df).select("row.doc_id", "row.text", "row.base", "base", "found").toDF("doc_id", "text", "own", "base", "found").collect()
    assert len(got) == len(rows)
    for r in got:
        assert [tuple(s) for s in r.base] == plain_secrets(r.text or "") and r.own == "b"
        values = [r.text[s.start : s.end] for s in r.found]
        if r.doc_id in planted:
            assert values == [planted[r.doc_id]] and r.found[0].score > 0.99999
        elif r.doc_id is not None and r.doc_id < 1000:
            assert values == []
        assert all(s.end <= b.start or s.start >= b.end for s in r.found for b in r.base)


def test_secrets_without_labels(spark):
    schema = "doc_id long, text string"
    assert secrets.find(spark.createDataFrame([], schema)).count() == 0
    only = secrets.find(spark.createDataFrame([(1, "password=abcdefgh12")], schema)).first()
    assert [tuple(s) for s in only.base] == [(0, 0, 19)] and only.found == []


def test_sketch_counts_exactly():
    sketch = secrets.Sketch(10)
    words = [f"word{i % 97}" for i in range(2000)]
    for w in words:
        sketch.add(w, 1)
    least = sorted(set(words), key=lambda w: secrets.xxhash.xxh64_intdigest(w))[:10]
    assert all(sketch.counts[w] == words.count(w) for w in least) and sketch.total == 2000


# --- Centroids -------------------------------------------------------------------


def plain_clusters(rows, k, rounds, dims, scale):
    kept = [(i, [int(np.floor(float(x) * scale)) for x in v]) for i, v in rows if usable(v, dims)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centres = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centres)]
    last = [(i, *near(v)) for i, v in kept]
    top = (1 << 63) - 1
    within = defaultdict(int)
    for _, d, j in last:
        within[j] += d
    mark = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, min(d, top), min(within[j], top), min(sum(within.values()), top), mark[j]) for i, d, j in last), key=repr)


def usable(v, dims):
    return v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_clusters(spark, kind):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-9, 9, 6) / 8]) for i in range(120)]
    rows += [(7, [0.5] * 6), (7, [0.25] * 6), (None, [0.1] * 6), (200, None), (201, []), (202, [1.0] * 5), (203, [1.0] * 5 + [None])]
    rows += [(204, [float("nan")] + [0.0] * 5), (205, [float("inf")] + [0.0] * 5)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("cluster", F.lit("own")).repartition(3)
    rows = [(i, v if v is None or kind == "double" else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for k in (1, 8, 500):
        got = centroids.clustered(df, k=k, rounds=3, dims=6)
        assert sorted((tuple(r) for r in shown(got)), key=repr) == plain_clusters(rows, k, 3, 6, 1024)


def shown(got):
    return got.select("row.vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()


def test_large_components_are_exact(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([[1e15, 2.0], [-1e15, 1.0], [1e15 - 8, 2.5], [3e9, 3e9], [2.0**52, 0.0], [1.0, 1.0], [1e300, 0.0]])]
    got = centroids.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2, rounds=4, dims=2)
    assert sorted((tuple(r) for r in shown(got)), key=repr) == plain_clusters(rows[:-1], 2, 4, 2, 1024)


def test_no_vectors(spark):
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert centroids.clustered(none).count() == 0 and centroids.clustered(none.limit(0)).count() == 0
