"""Each operator against a plain rule on small frames with nulls, ties, repeats and odd texts."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docmark.llm import (
    chat_format,
    decontaminate,
    langid,
    near_dedup,
    neighbours,
    packing,
    quality,
    repeats,
    secrets,
    token_output,
)
from docmark.llm.tokens import encoder, vocabulary_path

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(rng, n, words=400):
    return " ".join(rng.choice("aeiou") + str(rng.randrange(words)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    shared = prose(rng, 60)
    base = prose(rng, 120)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "é ü ñ"), (4, "one two"), (5, "ab " * 200), (None, base), (None, base)]
    rows += [(10 + i, f"{prose(rng, 20)} {shared}\n\n{prose(rng, 15)}") for i in range(6)]
    near = base.split()
    for i in range(8):
        near[rng.randrange(len(near))] = f"x{i}"
        rows.append((30 + i, " ".join(near)))
    rows += [(50, prose(rng, 3000)), (51, base.upper()), (52, "A B"), (53, "a b"), (60, rows[9][1]), (10, rows[8][1])]
    return rows


def test_repeats_match_a_count_of_windows(spark, corpus):
    words = [SPACE_WORDS.findall(t or "") for _, t in corpus]
    seen = Counter(tuple(w[k : k + 35]) for w in words for k in range(len(w) - 34))
    want = Counter()
    for (i, _), w in zip(corpus, words, strict=True):
        gone = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        want[(i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    docs = spark.createDataFrame(corpus, DOCS).withColumn("n_words", F.lit("clash"))
    for options in ({}, {"max_group": 1, "shard_segments": 3}):
        got = repeats.find_repeats(docs, **options).select("doc_id", "n_words", "n_removed", "kept")
        assert Counter(tuple(r) for r in got.collect()) == want
    assert repeats.find_repeats(docs.limit(0)).count() == 0


def test_components_take_links_from_one_evaluation(spark):
    seen = spark.sparkContext.accumulator(0)

    def links(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            k = batch.column("id").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"n{i:02}".encode() for i in k]), pa.array([f"n{i + 2:02}".encode() for i in k])], ["a", "b"])

    chain = spark.range(0, 20, 1, 4).mapInArrow(links, "a binary, b binary")
    got = {r.node.decode(): r.root.decode() for r in near_dedup.components(chain).collect()}
    assert got == {f"n{i:02}": f"n{i % 2:02}" for i in range(22)}
    assert seen.value == 20


def test_keep_one_leaves_different_texts(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(1, base), (2, base + " end"), (2, base + " end"), (3, "alone"), (3, "alone"), (4, None), (5, ""),
            (None, base), (None, "no id, first"), (None, "no id, second")]
    got = near_dedup.keep_one(spark.createDataFrame(rows, DOCS).withColumn("id", F.lit("x")))
    assert got.columns == ["doc_id", "text", "id"]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(
        [(1, base), (3, "alone"), (4, None), (5, ""), (None, "no id, first"), (None, "no id, second")])


def test_near_duplicates_match_all_pairs(spark, corpus):
    for n, percent in ((3, 85), (5, 80)):
        sets = []
        for _, t in corpus:
            w = SPACE_WORDS.findall(lower(t))
            sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
        root = list(range(len(sets)))

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    root[find(i)] = find(j)
        least = defaultdict(lambda: None)
        for k, (i, _) in enumerate(corpus):
            r = find(k)
            least[r] = i if least[r] is None else min(least[r], i if i is not None else least[r])
        want = Counter((i, len(s), least[find(k)], i == least[find(k)]) for k, ((i, _), s) in enumerate(zip(corpus, sets, strict=True)))
        docs = spark.createDataFrame(corpus, DOCS).withColumn("id", F.lit(1))
        for options in ({}, {"node_limit": 4, "max_depth": 2}):
            got = near_dedup.near_duplicates(docs, words=n, percent=percent, **options)
            assert Counter(tuple(r) for r in got.collect()) == want
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_large_nodes_are_branched_by_several_levels_at_once(spark, monkeypatch):
    names = []
    write = near_dedup.written
    monkeypatch.setattr(near_dedup, "written", lambda df, name: names.append(name) or write(df, name))
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:150], f"x{i}", *base[150:]])) for i in range(12)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), words=3, percent=85, node_limit=2)
    assert {r.component_id for r in got.collect()} == {0}
    assert names.count("near-nodes") <= 1 + near_dedup.MAX_DEPTH // near_dedup.LEVELS


def test_only_wanted_texts_are_sent(spark):
    texts = spark.range(5000).select((F.col("id") * 7).alias("__k1"), F.col("id").alias("__k2"), F.lit("t").alias("text"))
    keys = texts.where("__k2 < 20").select("__k1", "__k2")
    got = near_dedup._met(texts, keys, ["__k1", "__k2"])
    assert got.columns == texts.columns
    assert {r["__k2"] for r in got.collect()} >= set(range(20))
    assert got.count() < 40
    assert near_dedup._met(texts, keys.limit(0), ["__k1", "__k2"]).count() == 0


def _template_pages(rng, pages, shared, own):
    """Pages of one template that agree in it only, and of every page a copy with some words changed, as near as 0.85."""
    template = [f"t{i}" for i in range(shared)]
    rows = []
    for i in range(pages):
        words = template + [f"o{i}x{k}" for k in range(own)]
        near = list(words)
        for k in rng.sample(range(0, len(near), 8), 2):
            near[k] = f"n{i}x{k}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(near))]
    return rows


def test_pairs_far_from_all_others_in_large_nodes_are_linked(spark):
    rows = _template_pages(random.Random(9), 250, 88, 12)
    sets = [{tuple(t.split()[k : k + 3]) for k in range(98)} for _, t in rows]
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(0.85 <= alike(2 * i, 2 * i + 1) < 0.95 for i in range(250))
    assert max(alike(i, j) for i in range(500) for j in range(i) if i // 2 != j // 2) < 0.85
    docs = spark.createDataFrame(rows, DOCS)
    got = near_dedup.near_duplicates(docs, words=3, percent=85, node_limit=4, max_depth=0)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: i // 2 * 2 for i in range(500)}


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 3, near_dedup.CELLS)
    for percent in (80, 85):
        for n in (1, 2, 7, 40, 200):
            for _ in range(40):
                a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
                lost = rng.integers(0, len(a) * (100 - percent) // 100 + 1)
                b = rng.permutation(a)[lost:]
                assert len(b) * 100 >= percent * len(a)
                assert np.intersect1d(near_dedup.prefix(a, counts, percent), near_dedup.prefix(np.sort(b), counts, percent)).size


def test_every_two_blocks_of_a_common_shingle_meet(spark):
    texts = spark.createDataFrame([(bytes([i]), "a b c d e") for i in range(30)], "class binary, text string")
    nodes = defaultdict(set)
    for r in near_dedup._exact_leaves(texts, 3, 80, 8).collect():
        nodes[r.node].add(bytes(r["class"]))
    assert all(any({bytes([i]), bytes([j])} <= m for m in nodes.values()) for i in range(30) for j in range(i))


def test_pages_of_one_template_meet_in_linearly_many_rows(spark):
    made = []
    for pages in (50, 200):
        rows = _template_pages(random.Random(9), pages, 88, 12)
        texts = spark.createDataFrame([(i.to_bytes(16), t) for i, t in rows], "class binary, text string")
        nodes = defaultdict(set)
        for r in near_dedup._exact_leaves(texts, 3, 85, 16).collect():
            nodes[r.node].add(int.from_bytes(r["class"]))
        assert all(any({2 * i, 2 * i + 1} <= m for m in nodes.values()) for i in range(pages))
        made.append(sum(map(len, nodes.values())))
    assert made[1] <= 4.4 * made[0]


def test_small_scratch_tables_are_few_files(spark, monkeypatch):
    made, write = [], near_dedup.written
    monkeypatch.setattr(near_dedup, "written", lambda df, name: made.append(write(df, name)) or made[-1])
    most = 4 * spark.sparkContext.defaultParallelism
    conf = {"spark.sql.shuffle.partitions": str(most + 10), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        pairs = spark.range(2000).select(F.expr("CAST(CAST(2 * id AS STRING) AS BINARY)").alias("a"),
                                         F.expr("CAST(CAST(2 * id + 1 AS STRING) AS BINARY)").alias("b"))
        got = near_dedup.components(pairs, 2000).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 4000
    assert {(int(r.node) // 2, int(min(str(int(r.node) // 2 * 2 + k) for k in (0, 1)))) for r in got} == {
        (int(r.root) // 2, int(r.root)) for r in got}
    assert all(0 < len(df.inputFiles()) <= most for df in made)


def test_members_of_a_node_are_linked_with_the_first_of_their_component():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(8):  # a core, and sets whose distances to each other lie about the threshold
        core = np.unique(rng.integers(0, 2**63, 100, dtype=np.uint64))
        sets += [np.unique(np.concatenate([rng.permutation(core)[:95], rng.integers(0, 2**63, 5, dtype=np.uint64)])) for _ in range(20)]
    sketches = near_dedup._signatures(sets, near_dedup.TOKENS).astype(np.uint8)
    rows = [{"class": i.to_bytes(16), "root": i.to_bytes(16), "short": True, "n": len(s), "sketch": k.tobytes()}
            for i, (s, k) in enumerate(zip(sets, sketches, strict=True))]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    got = near_dedup._Node(rows, 85, 0).links(sets)
    assert 8 < len(set(root)) < len(sets) - 8
    assert sorted(got) == sorted((r, i) for i, r in enumerate(root) if r != i)


def test_decontamination_matches_a_search(spark, corpus):
    items = [(7, corpus[8][1]), (8, "AB ab!ab"), (9, None), (10, "..."), (None, "é ü"), (11, corpus[-3][1])]
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM_WORDS.findall(lower(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add("" if i is None else str(i))
    want = Counter()
    for i, t in corpus:
        w, hit, found = ALNUM_WORDS.findall(lower(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        want[(i, len(w), len(hit), tuple(sorted(found)))] += 1
    docs = spark.createDataFrame(corpus, DOCS).withColumn("items", F.lit(3))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for limit in (1000, 30):
        got = decontaminate.find_contamination(docs, bench, max_broadcast=limit)
        assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got.collect()) == want
    assert decontaminate.find_contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    kept = decontaminate.remove_contamination(docs, bench).collect()
    assert {r.doc_id for r in kept if r.text == dict(corpus).get(r.doc_id)} >= {0, 1, 2, 50}  # 52 holds nothing but an item
    again = decontaminate.find_contamination(spark.createDataFrame([(r.doc_id, r.text) for r in kept], DOCS), bench)
    assert again.where("n_hit > 0 and doc_id = 10").count() == 0


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path()).encode(text or "", add_special_tokens=False).ids + [1]


def test_encoding_is_the_tokenizers_own():
    odd = ["a   b", "a \n b  ", " lead", "x\n\n\ny  z", "it's  don't", "<|endoftext|> end ", "é,  ñ. k", "t\t x \t y", "a, b.c ,d", "1, 2.",
           " " * 3000 + "x", "x" + "\n" * 999 + "y", "ab" * 5000, "IT'S 'Ll", "\u0085 \xa0x\u3000"]
    assert encoder().fast is not None
    assert [v.tolist() for v in encoder().encode([*odd, None])] == [ids_of(t) for t in [*odd, None]]
    marks = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000]
    for at in range(0, len(marks), 4096):
        text = "\n".join(f"a{c}b {c}1{c} {c}{c} .{c}'s  {c} \n{c}" for c in marks[at : at + 4096])
        assert encoder().fast.encode_ordinary(text) == encoder().tokenizer.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_are_left_to_tokenizers():
    other = encoder(vocabulary_path("word_bpe_49k.json"))
    assert other.fast is None
    texts = ["Some words, é", ""]
    assert [v.tolist()[:-1] for v in other.encode(texts)] == [other.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_keeps_every_id_once(spark, corpus):
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(corpus)], DOCS).withColumn("length", F.lit("clash"))
    for options in ({"length": 64}, {"length": 64, "max_open": 2}, {}):
        rows = packing.pack(docs, **options).collect()
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in rows:
            pieces[r.doc_id].append((r.start, r.ids))
            sequences[r.sequence_id].append((r.offset, r.length))
            assert r.length == len(r.ids)
        for k, (_, t) in enumerate(corpus):
            found = sorted(pieces[k])
            assert [s for s, _ in found] == list(np.cumsum([0] + [len(i) for _, i in found])[:-1])
            assert [x for _, i in found for x in i] == ids_of(t)
        for parts in sequences.values():
            ends = np.cumsum([n for _, n in sorted(parts)])
            assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]]
            assert ends[-1] <= options.get("length", 2048) and ends[-1] & (ends[-1] - 1) == 0
    checked = packing.digest(packing.pack(docs)).collect()
    assert all(r.ids_crc32 == zlib.crc32(np.array(ids_of(corpus[r.doc_id][1])[r.start : r.start + r.length], "<u4").tobytes()) for r in checked)
    assert packing.pack(docs.limit(0)).count() == 0


def test_matrix_rows_give_the_ids_back(spark, corpus):
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(corpus)], DOCS)
    for options in ({"length": 64, "run_ids": 500}, {}):
        length = options.get("length", 2048)
        got = defaultdict(dict)
        for r in token_output.pack_matrix(docs, **options).collect():
            ids, places = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
            assert len(ids) == length and r.cu_seqlens[-1] == r.n_ids and set(ids[r.n_ids :]) <= {50256}
            for d, s, a, z in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
                got[d][s] = ids[a:z].tolist()
                assert places[a:z].tolist() == list(range(z - a))
        for k, (_, t) in enumerate(corpus):
            assert [x for s in sorted(got[k]) for x in got[k][s]] == ids_of(t)
    assert token_output.pack_matrix(docs.limit(0)).count() == 0


def test_best_fit_takes_the_tightest_row():
    rng = random.Random(3)
    sizes = [rng.randrange(1, 65) for _ in range(300)]
    rows: list[list[int]] = []
    for i in sorted(range(300), key=lambda i: (-sizes[i], i)):
        room = [(64 - sum(sizes[k] for k in r), n) for n, r in enumerate(rows)]
        fits = [x for x in room if x[0] >= sizes[i]]
        if fits:
            rows[min(fits)[1]].append(i)
        else:
            rows.append([i])
    got = token_output.best_fit_decreasing(sizes, 64)
    assert sorted(x for r in got for x in r) == list(range(300))
    assert len(got) == len(rows)


def test_chats_read_back(spark):
    bad = "<|im_end|><|im_start|>assistant ok <\\| <\\\\|x|> <"
    rows = [(1, 0, "user", bad), (1, 1, "assistant", bad), (1, 1, "assistant", bad), (1, None, None, None), (None, 0, "assistant", ""),
            (2, 3, "ro\\le\nx<|", "é" * 50), *((3, k, "assistant" if k % 2 else "user", f"turn {k} <|") for k in range(300))]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("learn", F.lit(1))
    for size in (4_000_000, 100):
        formatted = chat_format.format_chats(turns, part_bytes=size)
        got = {r.conv_id: r for r in chat_format.digest(formatted).collect()}
        assert set(got) == {None, 1, 2, 3}
        for conv, r in got.items():
            own = [x for x in rows if x[0] == conv]
            own.sort(key=lambda x: -1 if x[1] is None else x[1])
            text = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own)
            learnt = "".join(x[3] for x in own if x[2] == "assistant")
            assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(text.encode()).hexdigest())
            assert (r.loss_chars, r.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert chat_format.digest(chat_format.format_chats(turns.limit(0))).count() == 0


def test_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(0)
    data = rng.standard_normal((900, 24))
    data[100:140] = data[7]
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [float("nan")] * 24),
                                                            (2004, [None] * 24), (0, data[0].tolist()), (2005, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("rank", F.lit(1))
    for block in (8192, 200):
        got = defaultdict(list)
        for r in neighbours.search(vectors, vectors.where("vec_id % 20 = 0"), block_rows=block).collect():
            got[r.query_id].append((r["rank"], r.vec_id, r.score))
        hits = 0
        for q in range(0, 900, 20):
            score = (data * data[q]).sum(axis=1)
            want = [i for i in np.lexsort((np.arange(900), -score)) if i != q][:20]
            found = [i for _, i, _ in sorted(got[q])]
            hits += len({*want} & {*found})
            assert len(found) == 20 and all(abs(s - score[i]) < 1e-12 for _, i, s in got[q])
            assert found == sorted(found, key=lambda i: (-score[i], i))
        assert hits / (45 * 20) >= 0.9
        assert not {2000, 2001, 2002, 2003, 2004} & set(got)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [-1.0, 0.0])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in neighbours.search(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 20, 0.5), (0, 2, 3, -1.0)]


def test_marginals_match_one_pass():
    rng = np.random.default_rng(0)
    bounds = np.array([0, 3, 3, 200, 201, 330])
    emission, moves = rng.normal(size=(330, 3)), rng.normal(size=(3, 3))
    got = langid.marginals(emission, bounds, moves)
    for a, z in zip(bounds, bounds[1:], strict=False):
        if a == z:
            continue
        x, step = np.exp(emission[a:z]), np.exp(moves)
        ahead, back = [x[0]], [np.ones(3)]
        for t in range(1, z - a):
            v = (ahead[-1] @ step) * x[t]
            ahead.append(v / v.sum())
        for t in range(z - a - 1, 0, -1):
            v = step @ (x[t] * back[-1])
            back.append(v / v.sum())
        p = np.array(ahead) * np.array(back[::-1])
        assert np.allclose(p / p.sum(axis=1, keepdims=True), got[a:z])


def test_languages_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = langid.fit(docs.select("doc_id", "text", "lang"))
    found = langid.identify(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"), field)
    assert found.where("lang = lang_pred").count() >= 0.95 * found.count()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 — !"), (4, "de")], DOCS)
    assert [r.lang_pred for r in langid.identify(odd, field).orderBy("doc_id").collect()][:3] == ["und"] * 3
    assert [r.score for r in langid.identify(odd, None).collect()] == [0.0] * 4
    assert langid.identify(docs.limit(0), field).count() == 0


def test_quality_on_held_out_texts(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    net = quality.fit(docs, labels)
    test = docs.join(labels, "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    rows = quality.score(test, net).select("quality", "predicted").collect()
    assert np.mean([r.predicted == 1 for r in rows if r.quality == 1]) >= 0.99
    assert np.mean([r.predicted == 0 for r in rows if r.quality == 0]) >= 0.85
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 300_000)], DOCS).withColumn("score", F.lit("clash"))
    got = {r.doc_id: r.score for r in quality.score(odd, net).collect()}
    assert got[1] == got[2] and all(0 <= s <= 1 for s in got.values())
    assert quality.fit(docs, labels.limit(0)) is None
    assert quality.score(docs.limit(0), None).count() == 0


def test_convolution_sees_every_byte():
    net = quality.train([b"good text " * 30, b"bad!! bad!!" * 30], np.array([1, 0], np.float32), epochs=1)
    text = bytes(random.Random(0).randrange(1, 256) for _ in range(1000))
    data, first = quality.layout([text, b"", text[:3]])
    best, _ = quality.convolve(net, data, int(first[-1]))
    padded = text + bytes(quality.WIDTH)
    plain = [sum(net.tables[k][padded[i + k]] for k in range(quality.WIDTH)) for i in range(len(text))]
    cells, start = quality.chunks(first)
    assert set(cells[: start[1]].ravel()) == set(range(first[1]))
    assert np.all(best[: first[1]].max(axis=0) >= np.max(plain, axis=0) - 1e-4)


def test_secrets_found_and_prose_left(spark):
    rng = random.Random(5)
    docs = [(i, f"{prose(rng, 30)} extraordinarilylongword{i} {'token = ' + chr(34) + hashlib.sha1(str(i).encode()).hexdigest() + chr(34) if i % 3 == 0 else ''} end")
            for i in range(120)]
    docs += [(500, None), (501, ""), (502, "AKIA" + "B7" * 8)]
    frame = spark.createDataFrame(docs, DOCS).withColumn("start", F.lit("clash"))
    scanner = secrets.fit(frame)
    found = secrets.scan(frame, scanner)
    assert {r.doc_id for r in found.collect()} == {i for i in range(0, 120, 3)} | {502}
    clean = {r.doc_id: r.text for r in secrets.redact(frame, found).collect()}
    assert len(clean) == len(docs) and clean[500] is None and clean[1] == docs[1][1]
    assert hashlib.sha1(b"3").hexdigest() not in clean[3] and secrets.MARK in clean[3]
    marks = spark.createDataFrame([(0, docs[0][1].index(hashlib.sha1(b"0").hexdigest()), 0)], "doc_id bigint, start bigint, label int")
    assert secrets.scan(frame, secrets.fit(frame, labelled=marks)).count() == 0
    assert secrets.scan(frame.limit(0), scanner).count() == 0


def test_secret_candidates_beside_names_and_paths():
    aws, github, sha = "AKIA" + "B7" * 8, "ghp_" + "a1B2" * 9, hashlib.sha1(b"x").hexdigest()
    pem = "-----BEGIN RSA PRIVATE KEY-----\nMIIEow\n-----END RSA PRIVATE KEY-----"
    for text, value, kind in (
            (f"GITHUB_TOKEN={github} x", github, "github"), (f"AWS_ACCESS_KEY_ID={aws}", aws, "aws"), (f"api/v1/{aws}/x", aws, "aws"),
            (f"token={sha}", sha, "assigned"), (f"PRIVATE_KEY={pem} x", pem, "private_key"), (f"name=x/{sha}", sha, "run"),
            ('password: "p@s w0!"', "p@s w0!", "assigned"), ("pwd = x9", "x9", "assigned"), (f"AKIAAKIA{'B7' * 8}", aws, "aws"),
            (f"?a=1&token={sha}&b=2", sha, "assigned"), (f"Authorization: Bearer {sha}", sha, "assigned"), (f"id={sha}", sha, "run")):
        found = {(text[a:b], k) for a, b, k in secrets.candidates(text)}
        assert (value, kind) in found, (text, found)
    assert secrets.candidates("Author: J. Doe, 1999") == []


def test_secrets_beside_names_are_cut(spark):
    rng = random.Random(6)
    keys = [f"ghp_{rng.getrandbits(144):036x}" for _ in range(60)]
    docs = [(i, f"{prose(rng, 30)} {('GITHUB_TOKEN=' if i % 2 else 'api/v1/')}{k} token: the extraordinarilylongword{i} end") for i, k in enumerate(keys)]
    frame = spark.createDataFrame(docs, DOCS)
    clean = {r.doc_id: r.text for r in secrets.redact(frame, secrets.scan(frame, secrets.fit(frame))).collect()}
    assert all(clean[i] == docs[i][1].replace(k, secrets.MARK) for i, k in enumerate(keys))
    both = spark.createDataFrame([(1, "abcdefghij")], DOCS).withColumn("text_hash", F.xxhash64("text"))
    spans = both.select("doc_id", "text_hash", F.explode(F.expr("array(struct(1L AS start, 4L AS length), struct(3L AS start, 4L AS length))")).alias("s"))
    assert secrets.redact(both.drop("text_hash"), spans.select("doc_id", "text_hash", "s.*")).first().text == f"a{secrets.MARK}hij"


def test_dictionary_counts_every_text(spark):
    rows = [(i, "common words") for i in range(3000)] + [(None, "Rareword rareword")] * 400 + [(9000 + i, "zyx") for i in range(5)] + [(1, None)]
    language = secrets.learn_language(spark.createDataFrame(rows, DOCS).repartition(3))
    assert language.words == {"common", "words", "rareword", "zyx"}
    pairs = Counter()
    for _, t in rows:
        for w in re.findall(r"[a-z]+", (t or "").lower()):
            pairs.update(w[k : k + 2] for k in range(len(w) - 1))
    total = sum(pairs.values()) + 1
    assert language.pairs == {k: pytest.approx(np.log(n / total)) for k, n in pairs.items()}


def test_bytes_of_columns_with_offsets():
    roles, texts = pa.array(["x", "user", None])[1:], pa.array(["x", "a<|b", "é"])[1:]
    formatted, first, length = chat_format.assemble(roles, texts)
    assert formatted.to_pylist() == ["<|im_start|>user\na<\\|b<|im_end|>\n", "<|im_start|>\né<|im_end|>\n"]
    assert [t.encode()[a : a + n].decode() for t, a, n in zip(formatted.to_pylist(), first, length, strict=True)] == ["a<\\|b", "é"]
