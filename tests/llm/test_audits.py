"""Source divergence, mixing and the manifest against plain rules, on frames with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from docmark.llm import divergence, manifest, mixing
from docmark.llm.common import cut_words

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, value string, rank int, size string"
TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocabulary = ["Ab", "aB", "éa", "日本語", "abcdefgh", "abcdefghi", "abcdefghiJ", "abcdefgh" * 3, "abcdefgh" * 3 + "z", "x"]
    out = []
    for i in range(260):
        words = rng.choices(vocabulary, range(1, 11), k=rng.randrange(0, 30)) + [f"w{chr(97 + rng.randrange(26))}"]
        lang = rng.choice(["de", "de", "de", "en", None, ""])
        source = rng.choice(["s1", "s1", "s1", "s1", "s2", "s3", "Ä", None])
        out.append((i if i % 40 else None, rng.choice([" ", ". ", "\n-7-"]).join(words), lang, source, len(words), "c", i, "k"))
    out += [(900, None, "de", "s9", None, "c", 0, None), (901, "", "zz", "only", 0, "c", 0, None), (902, " 12 ", "zz", None, 4, "c", 0, None)]
    out += [(903, "Ab x " * 30_000, "en", "s2", 1, "c", 0, "k"), out[0], out[0], out[5], out[5]]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_pointers_are_sorted_and_cut_into_equal_runs():
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(rng.choice(list("aé"), rng.integers(1, 30))) for _ in range(200)) for _ in range(5)] + ["", "a a a"]
    words = cut_words(pa.array(texts), divergence.LETTERS, False)
    raw = [words.data[s:e].tobytes() for s, e in zip(words.starts, words.ends, strict=True)]
    order, runs = divergence.sorted_pointers(words)
    assert [raw[i] for i in order] == sorted(raw)
    assert all(a < b for a, b in zip(order, order[1:], strict=False) if raw[a] == raw[b])
    assert [raw[order[r]] for r in runs] == sorted(set(raw))


def audit_rule(rows, least):
    docs = [(la or "", so or "", Counter(ascii_lower(t) for t in TERMS.findall(tx or ""))) for _, tx, la, so, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in mine for t in d[2])
        kept = {t for t, n in seen.items() if n >= least}
        counts = defaultdict(Counter)
        for _, source, c in mine:
            counts[source].update({t: n for t, n in c.items() if t in kept})
        whole = sum(counts.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        for a in counts:
            pair = [(-sum(abs(p(counts[a], t) - p(counts[b], t)) for t in kept), b.encode()) for b in counts if b != a]
            term = [(p(whole, t) - p(counts[a], t), t.encode()) for t in counts[a] if p(counts[a], t) > p(whole, t)]
            out += [(lang, a, "pair", i.decode(), -v, k) for k, (v, i) in enumerate(sorted(pair), 1)]
            out += [(lang, a, "term", i.decode(), -v, k) for k, (v, i) in enumerate(sorted(term)[:50], 1)]
    return sorted(out)


def test_divergence_matches_a_plain_count(spark, rows):
    docs = frame(spark, rows)
    for least, options in ((30, {}), (2, {"tile": 2, "block_rows": 7})):
        got = divergence.audit(docs, least_docs=least, **options).select("lang", "source", "part", "item", "value", "rank")
        assert sorted(map(tuple, got.collect())) == audit_rule(rows, least)
    assert divergence.audit(docs.limit(0)).count() == 0


def targets_rule(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped: dict = {}
    while True:
        rest = sum(sizes.values()) - sum(capped.values())
        free = [s for s in order if s not in capped]
        level = {s: Fraction(rest * weight[s], sum(weight[s] for s in free)) for s in free}
        over = [s for s in free if level[s] > 3 * sizes[s]]
        if not over:
            return {**capped, **level}
        capped |= {s: 3 * sizes[s] for s in over}


def test_targets_fill_up_to_the_limit(spark):
    rng = random.Random(8)
    for n in (1, 2, 7, 40):
        sizes = {(f"s{i}" if i else None): rng.choice([0, 1, rng.randrange(50), rng.randrange(10**6), 10**12]) for i in range(n)}
        table = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {r.source: r.target for r in mixing.targets(table).collect()}
        want = targets_rule(sizes)
        assert got.keys() == want.keys() and all(got[s] == pytest.approx(float(want[s]), rel=1e-12) for s in want)


def test_mix_takes_what_the_plan_says(spark, rows, monkeypatch):
    docs = frame(spark, rows)
    planned = mixing.digest(mixing.plan(docs)).collect()
    sizes = Counter()
    for _, text, _, source, *_ in rows:
        sizes[source] += len(WORDS.findall(text or ""))
    assert Counter(r.source_size for r in planned) == Counter(sizes[r[3]] for r in rows)
    for r in planned:
        rate = r.target / r.source_size if r.source_size else 0
        assert r.taken in (r.size * int(rate), r.size * (int(rate) + 1)) and r.taken <= 3 * r.size
    again = mixing.digest(mixing.plan(docs.repartition(7))).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, planned))
    whole = mixing.mix(docs)
    assert whole.columns == [*docs.columns, "copy_no"]
    assert sum(len(WORDS.findall(r.text or "")) for r in whole.collect()) == sum(r.taken for r in planned)
    monkeypatch.setattr(mixing, "MAX_BROADCAST", 0)
    assert Counter(map(tuple, mixing.digest(mixing.plan(docs)).collect())) == Counter(map(tuple, planned))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_sources_come_near_their_targets(spark):
    rng = random.Random(5)
    many = [(i, "w " * rng.randrange(1, 60), "en", f"s{i % 4}" if i % 3 else "hot", 1, "", 0, "") for i in range(6000)]
    taken, target = Counter(), {}
    for r in mixing.digest(mixing.plan(frame(spark, many))).collect():
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert len(target) == 5 and all(abs(taken[s] - t) < 0.01 * t for s, t in target.items())


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def manifest_rule(rows):
    """Every proof by itself, on whole trees."""
    def leaf(doc_id, text, lang, source, n_chars):
        return sha(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in (doc_id, source, lang, n_chars, text)])

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def climb(levels, at, digest):
        proof = []
        for level in levels[:-1]:
            run = level[at // 8 * 8 : at // 8 * 8 + 8]
            proof += run[: at % 8] + run[at % 8 + 1 :]
            digest = sha(*run[: at % 8], digest, *run[at % 8 + 1 :])
            at //= 8
        return proof, digest

    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars, *_ in rows:
        own = leaf(doc_id, text, lang, source, n_chars)
        bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None
        groups[lang].append((doc_id, own, leaf(doc_id, ascii_lower(text), lang, source, n_chars) if bad else own))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for lang in order:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[lang] = tree([r[1] for r in groups[lang]])
    top = tree([trees[lang][-1][0] for lang in order])
    out = Counter()
    for g, lang in enumerate(order):
        for at, (doc_id, own, shown) in enumerate(groups[lang]):
            proof, digest = climb(trees[lang], at, shown)
            more, digest = climb(top, g, digest)
            out[doc_id, own, trees[lang][-1][0], top[-1][0], sha(*proof, *more), digest, digest == top[-1][0]] += 1
    return out


def test_manifest_matches_single_proofs(spark, rows):
    docs = frame(spark, rows)
    want = manifest_rule(rows)
    for levels in (1, 2, 4):
        proofs = manifest.prove(docs, shown=manifest.tampered(), block_levels=levels)
        assert Counter(map(tuple, manifest.digest(proofs).collect())) == want
    big = [(2**60 + i, f"T{i}", f"l{i:03}" if i < 70 else "l000", "s", i, "", 0, "") for i in range(700)]
    assert Counter(map(tuple, manifest.digest(manifest.prove(
        frame(spark, big), shown=manifest.tampered(), block_levels=1)).collect())) == manifest_rule(big)
    lone = manifest.prove(frame(spark, rows[:1])).collect()[0]
    assert lone.verified and lone.leaf == lone.subroot == lone.root and lone.proof_sha256 == sha()
    assert manifest.prove(docs.limit(0)).count() == 0


def test_missing_nodes_are_the_least_that_proofs_need():
    for leaves in (1, 5, 8, 9, 64, 65, 200, 520):
        sizes = manifest.level_sizes(leaves)
        for first, last in ((0, 0), (0, leaves - 1), (leaves // 3, leaves // 2), (leaves - 1, leaves - 1)):
            need, have = set(), {(0, i) for i in range(first, last + 1)}
            for k, size in enumerate(sizes[:-1]):
                for i in range(first // 8**k, last // 8**k + 1):
                    need |= {(k, j) for j in range(i // 8 * 8, min(i // 8 * 8 + 8, size)) if j != i}
                    have |= {(k, i)}  # on the way up, derived
            assert set(manifest.missing(first, last, leaves)) == need - have
