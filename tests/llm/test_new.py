"""MinHash near-duplicates, periodic runs and the Merkle manifest: brute force, the SQL form, and awkward rows."""

from __future__ import annotations

import collections
import glob
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from headcast.llm import merkle, minhash, registry, runs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: With columns that operators make themselves.
CLASH = SCHEMA + ", node long, tree string, pos int, leaf string, n_runs int, component_id string, key int"
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (4, "one"), (None, "null id text here now"), (5, "ÄÖ é ñ 你好 𝄞"), (6, "word " * 4000), (7, "a b c d e f"), (8, "a b c d e g")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None if i == 5 else "en" if i != 7 else "", "s", None if i == 2 else 3, 1, "t", 2, "l", 3, "c", 4) for i, t in ODD], CLASH)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# 11


def shingles(text, size=2):
    words = words_of(lowered(text))
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_groups(rows):
    """(id, number of shingles, smallest id reachable, kept) of each row, by comparing all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    root, posted = list(range(len(rows))), collections.defaultdict(list)

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in enumerate(sets):
        common = collections.Counter(j for x in s for j in posted[x])
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
        for x in s:
            posted[x].append(i)
    least = {}
    for i, (ident, _) in enumerate(rows):
        if ident is not None:
            least[top(i)] = min(least.get(top(i), ident), ident)
    return sorted((str(i), len(s), str(c), i == c) for (i, _), s, c in ((r, s, least.get(top(k))) for k, (r, s) in enumerate(zip(rows, sets))))


def got_groups(frame):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in frame.collect())


def edited(base, edits, rng):
    words = list(base)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def near_copies(rng, start, n_groups, size, words, most):
    rows = []
    for g in range(n_groups):
        base = [f"v{rng.randrange(400)}" for _ in range(words)]
        rows += [(start + g * size + k, edited(base, rng.randrange(most + 1), rng)) for k in range(size)]
    return rows


def test_minhash_on_documents(spark, sf, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute_groups(rows)
    assert got_groups(registry.queries()["op11_minhash"](spark, sf)) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    told = con.execute(registry.oracle_sql()["op11_minhash"]).df()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in told.itertuples()) == want


def test_minhash_links_at_the_border_and_in_crowds(spark):
    rng = random.Random(5)
    rows = near_copies(rng, 0, 60, 4, 60, 6) + near_copies(rng, 1000, 2, 150, 80, 9)
    # a passage that many share, with a rest of their own: buckets of many groups
    passage = [f"p{k}" for k in range(70)]
    rows += [(3000 + k, " ".join([*passage, *[f"u{k}x{j}" for j in range(20)]])) for k in range(120)]
    rows += [(4000 + k, " ".join([*passage, *[f"z{k // 2}x{j}" for j in range(29)], f"end{k}"])) for k in range(80)]
    rng.shuffle(rows)
    want = brute_groups(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_groups(minhash.near_duplicates(frame)) == want
    # blocks far smaller than the buckets give the same
    assert got_groups(minhash.near_duplicates(frame, block=16)) == want


def test_sketches_estimate_high_similarity():
    rng = np.random.default_rng(1)
    for share, low, high in ((0.9, 30, 70), (0.8, 75, 112), (0.5, 175, 225)):
        bits = []
        for _ in range(200):
            n = int(rng.integers(30, 300))
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1)
            b = a.copy()
            b[: round(n * (1 - share) / (1 + share))] = rng.integers(0, 1 << 63, round(n * (1 - share) / (1 + share)), dtype=np.uint64) << np.uint64(1)
            x, y = minhash.odd_sketches(np.array([minhash.samples(a), minhash.samples(b)])).view(np.uint64)
            bits.append(int(np.bitwise_count(x ^ y).sum()))
            p, q = (minhash.parities(z).view(np.uint64) for z in (np.unique(a), np.unique(b)))
            assert share < 0.8 or int(np.bitwise_count(p ^ q).sum()) <= minhash.allowed(np.array(len(a) + len(b))) + 1
        assert low < np.mean(bits) < high
        assert share < 0.8 or max(bits) <= minhash.FAR_BITS


def test_minhash_on_awkward_rows(spark, odd):
    assert got_groups(minhash.near_duplicates(odd)) == brute_groups([(r.doc_id, r.text) for r in odd.collect()])
    assert minhash.near_duplicates(odd.where("doc_id = 1 or doc_id = 2")).orderBy("doc_id").collect()[1][1:] == (0, 2, True)
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


# 12


def brute_runs(words):
    n, out = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] == words[i + q]:
                j = i
                while j + q < n and words[j] == words[j + q]:
                    j += 1
                start, end = i, j + q
                part = words[start:end]
                if end - start >= max(6, 4 * q) and all(any(part[t] != part[t + r] for t in range(len(part) - r)) for r in range(1, q)):
                    out.add((start, end - start, q))
                i = j
            i += 1
    return sorted(out)


def brute_row(ident, text):
    words = words_of(text)
    n, h = len(words), zlib.crc32(str(ident).encode()) if ident is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    last = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (ident, len(found), *last, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_equal_brute_force_on_random_words():
    rng = random.Random(3)
    for _ in range(1500):
        kinds, n = rng.choice([1, 2, 3, 5]), rng.randrange(60)
        some = lambda m: [rng.randrange(kinds) for _ in range(m)]
        root = some(rng.randint(1, 9))
        words = some(n) if rng.random() < 0.6 else some(rng.randrange(9)) + [root[i % len(root)] for i in range(n)] + some(rng.randrange(9))
        assert [tuple(r) for r in runs.find_runs(np.array(words, dtype=np.int64)).tolist()] == brute_runs(words)


def test_runs_of_documents(spark, sf, docs):
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: tuple(r) for r in registry.queries()["op12_runs"](spark, sf).collect()}
    short = {i: t for i, t in rows.items() if len(words_of(t)) <= 700}
    assert len(got) == len(rows) and len(short) > 150
    assert {i: got[i] for i in short} == {i: brute_row(i, t) for i, t in short.items()}
    assert sum(r[1] > 0 for r in got.values()) > 5


def test_runs_on_awkward_rows(spark, odd):
    small = odd.where("doc_id is null or doc_id <> 6")
    got = runs.find_periodic(small, tail=runs.id_tail()).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(brute_row(r.doc_id, r.text)) for r in small.collect())
    long = runs.find_periodic(odd.where("doc_id = 6"), keep_text=True).first()
    assert tuple(long)[:6] == (6, 1, 0, 4000, 1, 4_000_000) and long.collapsed == "word"
    # the size of what is worked on together changes nothing
    again = runs.find_periodic(small, tail=runs.id_tail(), words_at_once=1).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert runs.find_periodic(odd.limit(0)).count() == 0


# 13


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    """Levels of a tree from its leaves to its root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return levels


def brute_manifest(rows):
    def leaf(r, more=0):
        values = [r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + more, r.text]
        return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    by = collections.defaultdict(list)
    for r in rows:
        by[r.lang].append(r)
    langs = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    own, trees = {}, {}
    for g in langs:
        own[g] = sorted(by[g], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in own[g]])
    top = tree([trees[g][-1][0] for g in langs])
    out = []
    for place, g in enumerate(langs):
        for i, r in enumerate(own[g]):
            hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            now, proof = leaf(r, int(hit)), []
            for levels, at in ((trees[g], i), (top, place)):
                for level in levels[:-1]:
                    beside = at ^ 1
                    pair = [now] if beside >= len(level) else [level[beside], now] if beside < at else [now, level[beside]]
                    proof += [level[beside]] if beside < len(level) else []
                    now, at = digest("".join(pair)), at // 2
            root = top[-1][0]
            out.append((str(r.doc_id), leaf(r), trees[g][-1][0], root, digest("".join(proof)), now, now == root))
    return sorted(out)


def got_manifest(frame):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in frame.collect())


def test_manifest_equals_brute_force_and_sql(spark, sf, docs):
    got = registry.queries()["op13_merkle"](spark, sf)
    want = brute_manifest(docs.collect())
    assert got_manifest(got) == want and 0 < sum(not r[-1] for r in want) < len(want)
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    rows = con.execute(registry.oracle_sql()["op13_merkle"]).df()
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in rows.itertuples()) == want


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_blocks_of_any_size_give_one_tree(spark, docs, bits):
    some = docs.where("doc_id < 40 or lang = 'es'")
    assert got_manifest(merkle.tampered_report(some, bits=bits)) == brute_manifest(some.collect())


def test_manifest_of_awkward_rows(spark, odd):
    rows = odd.select("doc_id", "text", "lang", "source", "n_chars").collect()
    assert got_manifest(merkle.tampered_report(odd, bits=2)) == brute_manifest(rows)
    assert merkle.tampered_report(odd.limit(0)).count() == 0
    one = odd.where("doc_id = 5")
    alone = merkle.tampered_report(one).first()
    assert alone.leaf == alone.subroot == alone.root and alone.proof_sha256 == digest("")


def test_proofs_show_any_change(spark, docs):
    """Leaves of the table are verified by its manifest, those of an altered one aren't."""
    kept = merkle.manifest(docs, bits=3).select("doc_id", "path", "root")
    for change, good in ((F.col("text"), True), (F.concat(F.col("text"), F.lit(" ")), False)):
        now = docs.withColumn("text", change).select("doc_id", merkle.leaf_of([F.col(c) for c in merkle.FIELDS]).alias("now"))
        seen = {r[0] for r in merkle.verify(kept.join(now, "doc_id"), F.col("now")).select("verified").distinct().collect()}
        assert seen == {good}
