"""Merkle manifest, odd sketches and conversation trie, against plain versions."""

import random
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_llm import docs_of
from oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_manifest", "op12_oddsketch", "op13_trie"])
def test_oracle(spark, name):
    from tidemark.llm.queries import ORACLES, QUERIES
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) == ""


# --- Merkle manifest --------------------------------------------------------------------------------------------------

def plain_digest(text):
    return sha256(text.encode()).hexdigest()


def plain_leaf(row, text):
    return plain_digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def plain_levels(nodes, fan):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([plain_digest("".join(levels[-1][k:k + fan])) for k in range(0, len(levels[-1]), fan)])
    return levels


def plain_proofs(rows, fan, tampered):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""
    of = defaultdict(list)
    for row in rows:
        leaf = plain_leaf(row, row[4])
        small = None if row[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
        of[row[1]].append(((row[0] is not None, row[0] or 0), leaf, row[0], plain_leaf(row, small) if tampered(row[0]) else None))
    names = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        of[name].sort(key=lambda r: r[:2])
        trees[name] = plain_levels([r[1] for r in of[name]], fan)
    upper = plain_levels([trees[name][-1][0] for name in names], fan)
    out = []
    for i, name in enumerate(names):
        for k, (_, leaf, doc_id, changed) in enumerate(of[name]):
            folded, proof = changed or leaf, ""
            for levels, at in ((trees[name], k), (upper, i)):
                for level in levels[:-1]:
                    lo = at - at % fan
                    left, right = "".join(level[lo:at]), "".join(level[at + 1:lo + fan])
                    folded, proof, at = plain_digest(left + folded + right), proof + left + right, at // fan
            out.append((doc_id, leaf, trees[name][-1][0], upper[-1][0], plain_digest(proof), folded, folded == upper[-1][0]))
    return out


def every_fifth(doc_id):
    return doc_id is not None and crc32(str(doc_id).encode()) % 5 == 0


@pytest.mark.parametrize("fan, lift, n", [(2, 1, 70), (3, 2, 400), (16, 1, 900), (16, 3, 40)])
def test_proofs_equal_a_plain_tree(spark, fan, lift, n):
    from tidemark.llm import merkle
    rng = random.Random(n)
    sources = [None, "", "a", "A", "é", "\U0001F600", "z", *[f"s{k}" for k in range(30)]]
    rows = []
    for i in range(n):  # one source holds half of all rows; ids repeat
        source = "big" if rng.random() < 0.5 else rng.choice(sources)
        rows.append((rng.randrange(n), source, rng.choice([None, "en", "fr"]), rng.choice([None, 3, 12]), rng.choice([None, "", "Ab c", f"Text {i} É", "x" * 5000])))
    rows += rows[:9] + [(None, None, None, None, None)] * 3 + [(None, "a", "en", 1, "ABC")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"key": F.lit(1), "leaf": F.lit("x"), "pos": F.lit("y")})
    found = merkle.prove(docs.repartition(5), fan=fan, lift=lift)
    assert Counter(map(tuple, found.collect())) == Counter(plain_proofs(rows, fan, every_fifth))


def test_versions_copy_only_ancestors(spark, odd, none):
    from tidemark.llm import merkle
    leaves = [plain_digest(str(k)) for k in range(100)]
    block = merkle.Block(leaves, False, 4, 2)
    changed = merkle.Block([*leaves[:37], "f" * 64, *leaves[38:]], False, 4, 2)
    copied = block.version(37, "f" * 64)
    assert len(copied) == len(block.levels) == 5 and copied[-1] == changed.top != block.top
    assert [level[37 // 4 ** k] for k, level in enumerate(changed.levels)] == copied
    assert sum(a != b for x, y in zip(block.levels, changed.levels) for a, b in zip(x, y)) == 5  # all other nodes are shared
    rows = merkle.prove(odd, F.col("doc_id") == 1, copies=True).collect()
    assert len(rows) == odd.count()
    assert all((r["copied"] is None) == (r["doc_id"] != 1) and (r["copied"] is None or r["copied"][-1] == r["folded_root"]) for r in rows)
    assert {r["doc_id"] for r in rows if not r["verified"]} <= {1}
    assert merkle.prove(none).count() == 0
    with pytest.raises(ValueError):
        merkle.prove(odd, fan=1)


def test_positions_without_a_window_over_the_key(spark):
    from tidemark.llm.ordering import positions
    rows = [("a", k % 7, "same") for k in range(5000)] + [("b", None, "x"), ("b", 1, None)]
    out = positions(spark.createDataFrame(rows, "key string, t int, v string"), "key", ["t", "v"]).collect()
    of = defaultdict(list)
    for r in out:
        of[r["key"]].append((r["pos"], r["t"], r["total"]))
    assert [p for p, _, _ in sorted(of["a"])] == list(range(5000)) and [t for _, t, _ in sorted(of["a"])] == sorted(k % 7 for k in range(5000))
    assert sorted(of["b"]) == [(0, None, 2), (1, 1, 2)]


# --- odd sketches -----------------------------------------------------------------------------------------------------

def plain_sets(text, width):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    return {tuple(words[k:k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def plain_classes(texts, width=2, similarity=80):
    """The least index linked with each text by exact Jaccard similarity."""
    every = [plain_sets(t, width) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(every):
        for j, b in enumerate(every[:i]):
            both = len(a & b)
            if both and 100 * both >= similarity * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], every


def varied_texts(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(25):  # copies with a few words changed, from far below to far above the bound
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts.append(" ".join(words))
        for changes in (1, 5, 8, 10, 11, 13, 30):
            other = list(words)
            for at in rng.sample(range(200), changes):
                other[at] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(other))
    words = [f"v{k}" for k in range(400)]  # one large group, linked over steps
    texts += [" ".join(words[k:k + 200]) for k in range(0, 200, 4)]
    base = [f"t{k}" for k in range(100)]  # many texts that share most words and yet are no copies
    texts += [" ".join([*base, *[f"u{rng.randrange(10 ** 6)}" for _ in range(22)]]) for _ in range(60)]
    return texts + ["", None, " \n", "one", "ONE", "one two", "One\tTwo", "É é", "é É", "two one"]


def test_common_shingles_by_bits_and_by_lists(monkeypatch):
    from tidemark.llm import oddsketch
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 200)).astype(np.uint64)) for _ in range(40)]
    sketches = [bytes(64)] * 40
    for words in (1 << 22, 0):
        monkeypatch.setattr(oddsketch, "MATRIX_WORDS", words)
        held = oddsketch.Sets(list(range(40)), [len(s) for s in sets], sketches, [s.tobytes() for s in sets], 0.8, 512)
        others = np.array([3, 1, 39, 17])
        assert held.common(5, others).tolist() == [len(np.intersect1d(sets[5], sets[j])) for j in others]


@pytest.mark.parametrize("seed, nodes, words", [(1, 2048, 1 << 22), (2, 16, 0)])
def test_components_equal_those_by_exact_jaccard(spark, monkeypatch, seed, nodes, words):
    from tidemark.llm import oddsketch
    monkeypatch.setattr(oddsketch, "BLOCK_NODES", nodes)
    monkeypatch.setattr(oddsketch, "MATRIX_WORDS", words)
    texts = varied_texts(seed)
    expected, sets = plain_classes(texts)
    rows = {r["doc_id"]: r for r in oddsketch.near_copies(docs_of(spark, texts)).collect()}
    assert [rows[i]["component_id"] for i in range(len(texts))] == expected
    assert [rows[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert all(r["kept"] == (i == r["component_id"]) for i, r in rows.items())
    assert len(set(expected)) < len(texts) - 150


def test_sketches_estimate_the_similarity():
    from tidemark.llm import oddsketch
    sampler, rng, errors, over = oddsketch.Sampler(), np.random.default_rng(3), [], 0
    limit = oddsketch.most_bits()
    assert oddsketch.estimate(0) == 1.0 and 0.4 < oddsketch.estimate(limit) < 0.8
    for _ in range(300):
        a = rng.integers(0, 1 << 63, 500).astype(np.uint64)
        b = np.concatenate([a[:450], rng.integers(0, 1 << 63, 50).astype(np.uint64)])  # similarity 450 / 550
        x, y = (np.frombuffer(sampler.sketch(sampler.samples(s)), np.uint64) for s in (a, b))
        apart = int(np.bitwise_count(x ^ y).sum())
        over += apart > limit
        errors.append(oddsketch.estimate(apart) - 450 / 550)
    assert over == 0 and abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05
    assert sampler.keys(sampler.samples(a)) == sampler.keys(sampler.samples(a[::-1].copy()))


def test_near_copies_of_odd_rows(spark, odd, none):
    from tidemark.llm import oddsketch
    rows = oddsketch.near_copies(odd).collect()
    assert len(rows) == odd.count() and oddsketch.near_copies(none).count() == 0
    by_id = defaultdict(set)
    for r in rows:
        by_id[r["doc_id"]].add((r["n_shingles"], r["component_id"], r["kept"]))
    assert len(by_id[1]) == 1 and by_id[2] == {(0, 2, True)} and by_id[3] == {(0, 3, True)} and by_id[5] == {(0, 5, True)}
    assert {c for _, c, _ in by_id[None]} == {1, None}  # one is a near copy of row 1, the other has no text
    with pytest.raises(ValueError):
        oddsketch.near_copies(odd, bits=100)


# --- conversation trie ------------------------------------------------------------------------------------------------

def plain_trie(rows, group=20, heads=4):
    own = defaultdict(list)
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "")):
        own[conv].append((role or "", text or ""))
    built = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % heads
        built[c] = tuple(own.get(c - (abs(c) % group) * (1 if c >= 0 else -1), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    saved, leaves = Counter(), Counter()
    for p, m in members.items():
        words = len(p[-1][1].replace("\t", " ").replace("\n", " ").split()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * words
            leaves[p[:d]] += not children[p]
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), children[p], leaves[p], saved[p],
                   sha256(",".join(str(c) for c in m if len(built[c]) == len(p)).encode()).hexdigest()) for p, m in members.items())


def conversations(seed, n=160):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-60, 400), n):
        for turn in rng.sample([None, *range(9)], rng.randint(1, 9)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a", "a b", "", None, "x\ty z", "A b"])))
    same = [(c, t, "user", f"turn {t}") for c in range(1000, 1400, 20) for t in range(5)]
    return rows + same + [(500, t, "user", f"w{t % 5} v") for t in range(250)] + [(None, 1, "user", "lost")]


@pytest.mark.parametrize("seed, block", [(1, 64), (2, 4)])
def test_nodes_equal_a_plain_trie(spark, monkeypatch, seed, block):
    from tidemark.llm import trie
    monkeypatch.setattr(trie, "ENDS", 16)
    rows = conversations(seed)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"x": F.lit("x"), "depth": F.lit(1), "words": F.lit(None)})
    found = trie.prefix_trie(frame.repartition(6), block=block).collect()
    assert sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], *tuple(r)[3:]) for r in found) == plain_trie(rows)


def test_trie_of_odd_rows(spark):
    from tidemark.llm import trie
    schema = "conv_id long, turn long, role string, text string"
    assert trie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    turnless = [r for r in trie.prefix_trie(spark.createDataFrame([(c, 0, "u", "only") for c in range(1, 20)], schema)).collect() if r["depth"] == 0]
    assert len(turnless) == 1 and turnless[0]["n_convs"] == 19 and turnless[0]["parent_conv_id"] is None
    twice = trie.prefix_trie(spark.createDataFrame([(0, 1, "u", "a b")] * 2, schema)).collect()  # a repeated row is a turn of its own
    assert sorted(r["depth"] for r in twice) == [0, 1, 2] and {r["n_leaves"] for r in twice} == {1}
