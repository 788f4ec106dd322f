"""Secret scan with a random forest that removes false positives.

Candidates are found in whole texts by patterns: known key shapes at every place, private key blocks, values
assigned to names like token or password, and long runs of characters that keys are made of. For each candidate numbers are computed: its length and mix of
characters, how usual its transitions from character to character are, how much of it words of a
dictionary cover, whether it lies in a path or address, and what the words beside it say. A random
forest, trained from labelled findings, gives each the probability of being a secret.

Dictionary and transitions are counted over all texts, the forest is learned from a
bounded sample of the labelled findings of all texts (``TRAINING_FINDINGS`` of each kind and label).
Without labelled findings, a key of known shape and a value assigned to a name like token or password count as
secrets, unless the value is made of words or a placeholder; every other finding counts as none.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmark.llm.common import slices, written

#: Distinct words that a task counts before it passes its counts on.
COUNTED_WORDS = 200_000
TRAINING_FINDINGS = 1_000
#: Of findings assumed to be no secrets, all in so many texts are looked at for training, of more texts a share.
DENSE_TEXTS = 1_000
TREES, DEPTH = 20, 8
THRESHOLD = 0.5
MARK = "[secret]"

# Public shapes of keys, and names that secrets are assigned to.
SHAPES = {
    "aws": r"(?:AKIA|ASIA)[A-Z0-9]{16}",
    "github": r"gh[pousr]_[A-Za-z0-9]{36}",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "stripe": r"sk_(?:live|test)_[A-Za-z0-9]{16,}",
    "google": r"AIza[A-Za-z0-9_-]{35}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)",
}
NAMES = (r"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth(?!or(?!iz))|credential|private[_-]?key)")
#: What each shape begins with; every place of it is tried.
PREFIXES = {
    "aws": ("AKIA", "ASIA"), "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "slack": ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"), "stripe": ("sk_live_", "sk_test_"), "google": ("AIza",),
    "jwt": ("eyJ",), "private_key": ("-----BEGIN ",),
}
#: A match that starts within another of these ends with it, or starts in the same first part of it.
_NESTED = {"slack": re.compile(r"[A-Za-z0-9-]*"), "jwt": re.compile(r"[A-Za-z0-9_-]*")}

_SHAPES = {k: re.compile(p, re.DOTALL) for k, p in SHAPES.items() if k != "private_key"}
_PEM_BEGIN = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
_PEM_END = re.compile(r"-----END [A-Z ]*PRIVATE KEY-----")
_WORD = re.compile(r"[a-z]+")
_RUN = re.compile(r"[A-Za-z0-9+/=_-]{16,}")
_PIECE = re.compile(r"=*[^=]+=*")
_FOLDERS = re.compile(r"/?(?:[A-Za-z_-]{1,24}[0-9]{0,3}/)+")
_SET = re.compile(r"[:=]+")
_SPACE = re.compile(r"\s*(?:(?:Bearer|Basic|Token)\s+)?")
_BARE = re.compile(r"\S+")
_PLACEHOLDER = re.compile(
    r"example|sample|placeholder|change[_-]?me|dummy|redacted|your[_-]|<.*>|\$\{|\{\{|^%.*%$|\*{3}|\.{3}|(.)\1{7}|^(?:none|null|true|false)$",
    re.IGNORECASE)
_BEFORE = re.compile(rf"{NAMES}\w*[\"']?\s*[:=]+\s*[\"']?$", re.IGNORECASE)
_NAMED = re.compile(NAMES, re.IGNORECASE)
_PATH = re.compile(r"(?:https?:/|www\.|[\w.-]+/|\w:\\)\S*$")
_CLASSES = (re.compile(r"[a-z]"), re.compile(r"[A-Z]"), re.compile(r"[0-9]"), re.compile(r"[+/=_-]"))


@dataclass
class Language:
    """What is usual in texts: log shares of character pairs, and pieces of frequent words."""

    pairs: dict[str, float]
    words: frozenset[str]
    rare: float


def learn_language(docs: DataFrame, text: str = "text", words: int = 4_000) -> Language:
    """Counts words over all texts; only the table of pairs and the most frequent words come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches, "text"):
            for t in batch.column("text").to_pylist():
                seen.update(_WORD.findall(t.lower()))
            if len(seen) > COUNTED_WORDS:
                yield _counted(seen)
                seen = Counter()
        if seen:
            yield _counted(seen)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                for k in range(len(w) - 1):
                    seen[w[k : k + 2]] += n
        if seen:
            yield _counted(seen)

    counted = docs.select(F.col(text).alias("text")).where("text IS NOT NULL").mapInArrow(count, "word string, n bigint")
    counted = written(counted.where(F.length("word") <= 14).groupBy("word").agg(F.sum("n").alias("n")), "secret-words")
    pairs = {r[0]: r[1] for r in counted.mapInArrow(pair, "word string, n bigint").groupBy("word").agg(F.sum("n")).collect()}
    total = sum(pairs.values()) + 1
    top = counted.orderBy(F.desc("n"), "word").limit(words).collect()
    frequent = frozenset(r["word"] for r in top if len(r["word"]) >= 3)
    return Language({k: math.log(n / total) for k, n in pairs.items()}, frequent, math.log(1 / total))


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])


def _coverage(word: str, known: frozenset[str]) -> float:
    """Share of the letters and digits that words of the dictionary cover, longest first from the left."""
    at = covered = 0
    while at < len(word):
        for n in range(min(14, len(word) - at), 2, -1):
            if word[at : at + n] in known:
                covered += n
                at += n
                break
        else:
            at += 1
    return covered / max(1, len(word))


def measures(text: str, start: int, end: int, kind: str, language: Language) -> list[float]:
    """The numbers that the forest judges a candidate by."""
    whole = text[start:end]
    found = whole[:400]  # of a longer key block more would not change the shares
    n = len(found)
    before, after = text[max(0, start - 40) : start], text[end : end + 20]
    shares = [len(c.findall(found)) / n for c in _CLASSES]
    counts = Counter(found)
    entropy = -sum(v / n * math.log2(v / n) for v in counts.values())
    kinds = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in found]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1)
    low = found.lower()
    usual = sum(language.pairs.get(low[i : i + 2], language.rare) for i in range(n - 1)) / max(1, n - 1)
    return [
        float(min(len(whole), 5000)), *shares, entropy, changes, usual, _coverage(low, language.words), len(counts) / n,
        float(bool(_PATH.search(before)) or "/" in found.strip("/=")), float("." in after[:1]),
        float(bool(_BEFORE.search(before))), float(bool(_NAMED.search(before + " " + after))),
        float(before[-1:] in "\"'" and before != ""), float(kind not in ("run", "assigned"))]


def _shaped(text: str) -> Iterator[tuple[int, int, str]]:
    """Matches of each shape by itself, overlapping ones too."""
    for kind, pattern in _SHAPES.items():
        for prefix in PREFIXES[kind]:
            at = text.find(prefix)
            while at >= 0:
                m = pattern.match(text, at)
                if m:
                    yield at, m.end(), kind
                at = text.find(prefix, _NESTED[kind].match(text, at).end() if kind in _NESTED else at + 1)
    ends = None
    done = -1
    for m in _PEM_BEGIN.finditer(text) if PREFIXES["private_key"][0] in text else ():
        if m.start() < done:
            continue
        if ends is None:
            ends = [e.span() for e in _PEM_END.finditer(text)]
        k = bisect.bisect_left(ends, (m.end(), 0))
        done = ends[k][1] if k < len(ends) else len(text)
        yield m.start(), done, "private_key"


def _assigned(text: str) -> Iterator[tuple[int, int, str]]:
    """Values assigned to a name like token or password, of any length and characters: quoted, or up to white space."""
    for m in _SET.finditer(text):
        end = m.start()
        while end and text[end - 1].isspace():
            end -= 1
        end -= bool(end and text[end - 1] in "\"'")
        first = end
        while first and (text[first - 1].isalnum() or text[first - 1] in "_-."):
            first -= 1
        if not _NAMED.search(text, first, end):
            continue
        at = _SPACE.match(text, m.end()).end()
        if text[at : at + 1] in ("'", '"'):
            stop, line = text.find(text[at], at + 1), text.find("\n", at)
            if stop > 0 and (line < 0 or stop < line):
                if stop > at + 1:
                    yield at + 1, stop, "assigned"
                continue
            at += 1
        bare = _BARE.match(text, at)
        if bare:
            value = bare.group()
            if first and text[first - 1] in "?&":
                value = value.split("&")[0]
            value = value.rstrip("\"',;)]}>")
            if value:
                yield at, at + len(value), "assigned"


def _runs(text: str) -> Iterator[tuple[int, int, str]]:
    """Runs of characters of keys, without the names before a = in them; behind folders once more by themselves."""
    for m in _RUN.finditer(text):
        for part in _PIECE.finditer(m.group()):
            start, end = m.start() + part.start(), m.start() + part.end()
            start += len(part.group()) - len(part.group().lstrip("=")) if part.start() == 0 else 0
            if end - start >= 16:
                yield start, end, "run"
            folders = _FOLDERS.match(text, start, end)
            if folders and end - folders.end() >= 16:
                yield folders.end(), end, "run"


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each candidate of a text, in characters.

    They may overlap. A value within a key of known shape, and a run within either, are not named again.
    """
    found: list[tuple[int, int, str]] = []
    for some in (_shaped, _assigned, _runs):
        spans = sorted({(a, b) for a, b, _ in found})
        starts = [a for a, _ in spans]
        reach = list(accumulate((b for _, b in spans), max))
        for a, b, kind in some(text):
            k = bisect.bisect_right(starts, a)
            if not k or reach[k - 1] < b:
                found.append((a, b, kind))
    return sorted(found)


def _wordy(value: str) -> bool:
    """Words, a short number, a placeholder or a piece of program: nothing that is a secret by itself."""
    parts = [w for w in re.split(r"[-_. ,;!?]+", value[:400]) if w]
    return (all(w.isalpha() and (w.lower() == w.upper() or w.islower() or w.isupper() or w.istitle()) for w in parts)
            or (value.isdigit() and len(value) < 6) or bool(_PLACEHOLDER.search(value[:400])) or bool(re.match(r"[\w.]+[(\[]", value)))


def assumed_label(text: str, start: int, end: int, kind: str) -> int:
    """1 for a key of known shape and for an assigned value that is not made of words, else 0."""
    return int(kind not in ("run", "assigned") or (kind == "assigned" and not _wordy(text[start:end])))


_FOUND = "start bigint, length bigint, kind string, features array<double>"


def find_candidates(docs: DataFrame, language: Language, doc_id: str = "doc_id", text: str = "text",
                    assumed: bool = False, sparse: int = 1) -> DataFrame:
    """A row for each candidate of each text: the id, the text's hash, start, length, kind, features.

    assumed: adds the assumed label, and of candidates with label 0 takes one in ``sparse``.
    """
    kind_of_id = dict(docs.dtypes)[doc_id]
    shared = docs.sparkSession.sparkContext.broadcast(language)
    slim = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    names = ["id", "text_hash", "start", "length", "kind", "features", *["label"] * assumed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows, owner = [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                for start, end, kind in candidates(t or ""):
                    label = assumed_label(t, start, end, kind) if assumed else 1
                    if label or zlib.crc32(t[start:end].encode()) % sparse == 0:
                        owner.append(i)
                        rows.append((start, end - start, kind, measures(t, start, end, kind, shared.value), float(label)))
            if rows:
                at = pa.array(owner)
                columns = [pa.array(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(at), batch.column("text_hash").take(at), *columns[: len(names) - 2]], names)

    return slim.mapInArrow(run, f"id {kind_of_id}, text_hash bigint, {_FOUND}" + ", label double" * assumed)


@dataclass
class Scanner:
    language: Language
    forest: RandomForestClassificationModel | None  # None: all findings of the sample were alike
    constant: float = 0.0


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", labelled: DataFrame | None = None,
        findings: int = TRAINING_FINDINGS) -> Scanner:
    """Learns what is usual from all rows, and the forest from a bounded sample of the labelled findings of all rows.

    labelled: rows (id column, start, label 0 or 1) of findings to learn from instead of assumed ones.
    """
    total = docs.count()
    language = learn_language(docs, text)
    if labelled is None:
        known = find_candidates(docs, language, doc_id, text, True, max(1, total // DENSE_TEXTS))
    else:
        marks = labelled.select(F.col(doc_id).alias("id"), "start", F.col("label").cast("double").alias("label"))
        known = find_candidates(docs, language, doc_id, text).join(marks, ["id", "start"])
    order = Window.partitionBy("kind", "label").orderBy(F.xxhash64("text_hash", "start"))
    known = known.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= findings)
    known = written(known.select("features", "label"), "secret-findings")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return Scanner(language, None, max(counts, default=0.0))
    weight = F.lit(0.5) / F.when(F.col("label") == 1, F.lit(float(counts[1.0]))).otherwise(F.lit(float(counts[0.0])))
    frame = known.select(array_to_vector("features").alias("features"), "label", (weight * sum(counts.values())).alias("weight"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=11, weightCol="weight").fit(frame)
    return Scanner(language, forest)


def scan(docs: DataFrame, scanner: Scanner, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The findings that the forest takes for secrets: the id, text_hash, start, length, kind, score.

    Positions are characters of the whole text. Null and empty texts have no findings. Null ids and repeated
    rows are kept: each row gives its own findings. Other columns are not looked at. An empty table gives
    no rows.
    """
    found = find_candidates(docs, scanner.language, doc_id, text)
    if scanner.forest is None:
        scored = found.withColumn("score", F.lit(scanner.constant))
    else:
        scored = scanner.forest.transform(found.withColumn("features", array_to_vector("features"))).withColumn(
            "score", vector_to_array("probability")[1])
    return scored.where(F.col("score") >= threshold).select(
        F.col("id").alias(doc_id), "text_hash", "start", "length", "kind", "score")


def redact(docs: DataFrame, findings: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every finding replaced by a mark; same rows and columns. Texts without findings stay."""
    spots = findings.groupBy(F.col(doc_id).alias("__id"), F.col("text_hash").alias("__hash")).agg(
        F.collect_set(F.struct("start", "length")).alias("__spots"))
    hashed = docs.withColumn("__text_hash", F.xxhash64(text))
    joined = hashed.join(spots, hashed[doc_id].eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, found in zip(batch.column(text).to_pylist(), batch.column("__spots").to_pylist(), strict=True):
                parts, at, end = [], 0, -1
                for start, stop in sorted((s["start"], s["start"] + s["length"]) for s in found or ()):
                    if start > end:  # findings that overlap or touch share a mark
                        parts += [t[at:start], MARK]
                    at = end = max(end, stop)
                out.append("".join([*parts, t[at:]]) if parts else t)
            names = [c for c in batch.schema.names if c != "__spots"]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text else batch.column(c) for c in names], names)

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return joined.select(*(docs[c] for c in docs.columns), "__spots").mapInArrow(run, kinds)
