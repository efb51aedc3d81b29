"""The pipeline against a version of each stage by hand."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
import tiktoken

import corpus_pipeline
from headcast.llm import bpe, minhash, quality_rules, registry, secrets, simhash, similar


def alike(x: str, y: str, size: int = 5) -> bool:
    """Whether the sets of word shingles are alike by 0.8 or more, computed on the strings themselves."""
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()

    a, b = shingles(x), shingles(y)
    return 5 * len(a & b) >= 4 * len(a | b)


def groups_of(texts: list[str]) -> list[int]:
    """For each text the first text of its group, groups being what ``alike`` connects."""
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(texts[i]) <= 3 * len(texts[j]) + 20 and len(texts[j]) <= 3 * len(texts[i]) + 20 and alike(texts[i], texts[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(texts))]


def windows_cut(text: str, items: list[str], n: int = 10) -> str | None:
    """``text`` without the words of benchmark windows; None if they were over half of its words."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    known = collections.defaultdict(set)
    for item in items:
        words = word.findall(lower(item))
        size = min(n, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            known[size].add(tuple(words[i : i + size]))
    places = [m.span() for m in word.finditer(text)]
    words, hit = [lower(text[a:b]) for a, b in places], [False] * len(places)
    for size, windows in known.items():
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit[i : i + size] = [True] * size
    if 2 * sum(hit) > len(words):
        return None
    out, at = [], 0
    for k, (a, b) in enumerate(places):
        if hit[k]:
            if not k or not hit[k - 1]:
                piece = text[at:a]
                out.append(piece.strip(" ") if out else piece.rstrip(" "))
            at = b
    return " ".join([*out, text[at:].lstrip(" ")]) if any(hit) else text


def test_run_equals_the_stages_by_hand(spark, sf, tmp_path):
    prose = next(r for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect() if len(set(r.text.split())) > 40 and r.text.isascii() and not set(r.text) & set("#*$%&|<>"))
    words = prose.text.split()
    more = [(10_000 + k, " ".join([*random.Random(k).sample(words, len(words)), secret]), prose.lang, prose.source, 0) for k, secret in enumerate(("password: hunter22x", "aB3dE5gH7jK9mN1pQ3sT5v is it"))]
    spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = sorted(r.doc_id for r in quality_rules.judge_quality(docs).where("kept").collect())
    group = groups_of([rows[i].text for i in kept])
    left = [i for k, i in enumerate(kept) if group[k] == k]
    assert len(left) < len(kept)
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {i: windows_cut(rows[i].text, items) for i in left}
    assert any(t is None or t != rows[i].text for i, t in texts.items())
    texts = {i: t for i, t in texts.items() if t is not None}
    gpt = tiktoken.Encoding("own", pat_str=registry.public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(open(registry.BPE_VOCABULARY, "rb").read()), special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert sorted(got) == sorted(texts)
    marked = 0
    for i, r in got.items():
        spans = secret_spans(texts[i])
        want, at = [], 0
        for first, end in spans:
            if first >= at:
                want += [texts[i][at:first], "[SECRET]"]
            at = max(at, end)
        text = "".join(want) + texts[i][at:]
        marked += bool(spans)
        assert r.text == text and r.n_chars == len(text) and (r.lang, r.source) == (rows[i].lang, rows[i].source)
        ids = gpt.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.round_trip and r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
    assert marked


def secret_spans(text: str) -> list[tuple[int, int]]:
    """All spans, straight from the definition: base kinds, then what they leave of long strings that look random."""
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    base = [m.span() for m in assign.finditer(text) if len(m[2]) >= 6]
    base += [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20] + [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    more = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        touching, at, parts = sorted(s for s in base if s[0] < m.end() and m.start() < s[1]), m.start(), []
        for first, end in touching:
            if first > at:
                parts.append((at, first))
            at = max(at, end)
        parts = [*parts, (at, m.end())] if at < m.end() else parts
        for first, end in parts:
            value = text[first:end].strip("+/_=-") if touching else m[0]
            if len(value) >= 20 and not any(re.search(p, value) for p in secrets.WHOLLY_ALLOWED):
                bits = next(c.bits for c in secrets.CLASSES if re.search(c.members, value))
                entropy = max(-sum(n / 20 * math.log2(n / 20) for n in collections.Counter(value[i : i + 20]).values()) for i in range(len(value) - 19))
                if entropy >= bits:
                    more.append((first, end))
    return sorted(base + more)


def test_foreign_columns_are_carried_whatever_their_names(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30).selectExpr("*", "doc_id as items", "'h' as hits", "1.5D as n_words", "'s' as spans", "2 as base", "3 as __th", "4 as row", "5 as root", "6 as kept")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert all((r["items"], r.hits, r.n_words, r.spans, r.base, r["__th"], r["row"], r.root, r.kept) == (r.doc_id, "h", 1.5, "s", 2, 3, 4, 5, 6) for r in out.collect())
    assert corpus_pipeline.tokens(spark, docs, sf).where("items = doc_id and hits = 'h'").count() == 30


def test_rows_without_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (None, "x y"), (3, None)], "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "0L n_chars")
    rows = corpus_pipeline.near_copies(spark, docs, "").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == [(False, 1), (False, 3), (True, 0)]
    assert corpus_pipeline.near_copies(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("seed", [5, 6])
def test_texts_alike_are_one_and_shared_ids_are_not(spark, seed):
    """All five-word pairs of 0.8 or more are linked (recall 1), no others, and rows are known by id and text."""
    rng, texts = random.Random(seed), []
    for k in range(40):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice((40, 65, 200)))]
        texts.append(" ".join(base))
        for edits in (max(1, len(base) // 60), max(2, len(base) // 40), len(base) // 8):
            changed = list(base)
            for at in rng.sample(range(5, len(base) - 5), edits):
                changed[at] = f"x{rng.randrange(300)}"
            texts.append(" ".join(changed))
    group = groups_of(texts)
    beyond = [(a, b) for a in range(len(texts)) for b in range(a) if a // 4 == b // 4 and alike(texts[a], texts[b])]
    prints = [simhash.fingerprint(t.encode(), 2, distinct=True) for t in texts]
    assert any((prints[a] ^ prints[b]).bit_count() > 4 for a, b in beyond) and len(set(group)) > 40
    docs = spark.createDataFrame([*enumerate(texts), (2, "another text under a known id"), (1, "a further text of a dropped id")], "doc_id long, text string")
    docs = docs.selectExpr("doc_id", "text", "'en' lang", "'s' source", "0L n_chars")
    got = {(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert got == {(i, t) for i, t in enumerate(texts) if group[i] == i} | {(2, "another text under a known id"), (1, "a further text of a dropped id")}


def test_a_large_group_of_edited_copies_is_one_without_meeting_in_pairs(spark, monkeypatch):
    """A text and 300 copies with a word changed, and 300 copies of another text that isn't there itself."""
    rng, texts = random.Random(9), []
    for k in range(2):
        base = [f"w{k}x{rng.randrange(10_000)}" for _ in range(60)]
        texts += [" ".join(base)] if not k else []
        for _ in range(300):
            changed = list(base)
            changed[rng.randrange(60)] = f"y{rng.randrange(10**9)}"
            texts.append(" ".join(changed))
    asked = []
    confirmed = minhash.confirmed
    monkeypatch.setattr(minhash, "confirmed", lambda pairs, *rest: asked.append(pairs.count()) or confirmed(pairs, *rest))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group = groups_of(texts)
    got = {r.doc_id: r.root for r in similar.grouped(docs).collect()}
    linked = sum(1 for i in range(len(texts)) if got[i] == got[group[i]])
    assert linked == len(texts) and len(set(group)) == 2 and sum(asked) < 40 * len(texts)
    assert all(group[i] == group[j] for i in range(0, len(texts), 7) for j in range(0, len(texts), 11) if got[i] == got[j])


@pytest.mark.parametrize("shared", [120, 145])
def test_shared_boilerplate_hides_no_link(spark, shared):
    """Texts that share most of their words with many others, each with one twin: every twin is found, and nothing else."""
    rng, texts = random.Random(shared), []
    for _ in range(16):
        passage = [f"p{rng.randrange(10**6)}" for _ in range(shared)]
        for _ in range(30):
            own = [f"o{rng.randrange(10**6)}" for _ in range(200 - shared)]
            texts.append(" ".join(passage + own))
            own[rng.randrange(5, len(own) - 5)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(passage + own))
    got = {r.doc_id: r.root for r in similar.grouped(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(alike(texts[i], texts[i + 1]) and got[i] == got[i + 1] for i in range(0, len(texts), 2))
    assert len(set(got.values())) == len(texts) // 2


def test_stages_on_null_empty_and_very_long_texts(spark, sf, tmp_path):
    """What stages after the first do with texts that the first would drop, and a run over an empty table."""
    long = " ".join(f"w{k % 5000}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (4, long), (5, "a plain text of some words"), (None, "no id here")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (corpus_pipeline.decontaminated, corpus_pipeline.without_secrets):
        assert sorted(map(repr, stage(spark, docs, sf).select("doc_id", "text").collect())) == sorted(map(repr, docs.select("doc_id", "text").collect()))
    got = {(r.doc_id, r.text): r.n_tokens for r in corpus_pipeline.tokens(spark, docs, sf).collect()}
    assert got[1, None] == got[2, ""] == 0 and got[4, long] > 60_000
    kept = corpus_pipeline.near_copies(spark, docs, sf).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 4), (False, 5), (True, 0)]
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
