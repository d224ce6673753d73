"""Quality rules by distribution divergence: Jensen-Shannon distance of a document's histograms to its language's."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, written

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
_SYMBOL_BYTES = [c.encode() for c in SYMBOLS]
#: Character classes, by byte: a character beyond ASCII counts once, by its first byte.
CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "symbol", "other", "beyond", "more")


def _class_of_byte() -> np.ndarray:
    kind = np.full(256, 7)
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:?'\"-()")):
        kind[list(chars)] = k
    kind[list(SYMBOLS.encode())] = 6
    kind[128:192], kind[192:] = 9, 8
    return kind


_CLASS = _class_of_byte()
_USED = len(CLASSES) - 1  # all but the bytes that continue a character


#: Shares of character classes are counted in steps of 1 / STEPS for their medians.
STEPS = 10_000
#: Counts of words that a task holds before it sends them on.
HELD = 200_000


@dataclass(frozen=True)
class QualityRules:
    """Limits. Distances lie in 0 to 1. Histograms shorter than min_chars or min_words are not judged."""

    char_distance: float = 0.2
    word_distance: float = 0.75
    min_chars: int = 100
    min_words: int = 50
    common_words: int = 64


def class_counts(raw: bytes) -> np.ndarray:
    return np.bincount(_CLASS, weights=np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256), minlength=len(CLASSES))[:_USED]


def jensen_shannon(p: np.ndarray, q: np.ndarray, beyond: np.ndarray | None = None) -> np.ndarray:
    """Distance (base 2, so 0 to 1) of each row of p to each row of q; rows sum to 1, or to 0 (distance 1).

    beyond: shares of p's rows in places that p's columns leave out, where q has none.
    """
    p, q = p[:, None, :], q[None, :, :]
    m = (p + q) / 2

    def kl(x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / m), 0).sum(axis=2)

    more = 0.0 if beyond is None else beyond[:, None]
    gone = (p.sum(axis=2) + more == 0) | (q.sum(axis=2) == 0)
    return np.where(gone, 1.0, np.sqrt(np.clip((kl(p) + kl(q) + more) / 2, 0, 1)))


def repeats(words: list[bytes]) -> int:
    """Words that lie in a window of three found at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids = dict.fromkeys(words)
    if len(ids) == n:
        return 0
    code = np.fromiter(map(dict(zip(ids, range(len(ids)), strict=True)).__getitem__, words), dtype=np.int64, count=n)
    pair = code[:-1] * len(ids) + code[1:]
    if len(ids) < 2_000_000:
        window = pair[:-1] * len(ids) + code[2:]
    else:
        window = np.unique(pair, return_inverse=True)[1][:-1] * len(ids) + code[2:]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    hit = np.zeros(n, dtype=bool)
    for at in (order[1:][same], order[:-1][same]):
        for k in range(3):
            hit[at + k] = True
    return int(hit.sum())


def base_counts(text: str, raw: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(words), len(text) - spaces, sum(map(raw.count, _SYMBOL_BYTES)), len(lines) - len(set(lines)), repeats(words)


def language_references(docs: DataFrame, rules: QualityRules) -> list[tuple[str, list[float], dict[str, float]]]:
    """Per lang value: median shares of character classes, and shares of its most common words.

    All documents count, exactly, however they are dealt; medians, so that junk does not bend them. Each batch sends its shares, each task its counts of all
    words, as often as it holds HELD of them; their sums are exact. What reaches the driver is bounded by the number of
    languages. A null lang counts as none.
    """

    def sent(lang: list | pa.Array, kind: list | pa.Array, word: list | pa.Array, n: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(c if isinstance(c, pa.Array) else pa.array(c, pa.string()) for c in (lang, kind, word)), pa.array(n, pa.int64())], ["lang", "kind", "word", "n"])

    def sums_of(words: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, found in words.items():
            yield sent([lang], ["total"], [""], [sum(found.values())])
            yield sent(pa.repeat(lang, len(found)), pa.repeat("word", len(found)), pa.array((w.decode(errors="replace") for w in found), pa.string()), list(found.values()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            rows = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                words[lang].update(raw.split())
                if len(raw) >= rules.min_chars:
                    seen = class_counts(raw)
                    rows += [(lang, c, "", round(v)) for c, v in zip(CLASSES, (STEPS * seen / seen.sum()).tolist(), strict=False)]
            yield sent(*(list(zip(*rows, strict=True)) or [()] * 4))
            if sum(map(len, words.values())) >= HELD:
                yield from sums_of(words)
                words.clear()
        yield from sums_of(words)

    known = docs.where("lang IS NOT NULL").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    bound_batches(docs.sparkSession)
    sent_ = written(known.mapInArrow(count, "lang string, kind string, word string, n long"), "language_counts")
    sums = sent_.where("kind IN ('word', 'total')").groupBy("lang", "kind", "word").agg(F.sum("n").alias("n"))
    shares = sent_.where("kind NOT IN ('word', 'total')").groupBy("lang", "kind", "word", "n").agg(F.count("*").alias("times"))  # at most STEPS + 1 a class
    group = Window.partitionBy("lang", "kind", "word")
    shares = shares.withColumn("upto", F.sum("times").over(group.orderBy("n"))).withColumn("all", F.sum("times").over(group))
    medians = shares.where("2 * upto >= all").groupBy("lang", "kind", "word").agg(F.min("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = sums.where("kind = 'word'").withColumn("rank", rank).where(F.col("rank") <= rules.common_words).drop("rank")
    found: dict[str, dict] = defaultdict(lambda: {"words": {}})
    for r in sums.where("kind = 'total'").unionByName(medians).unionByName(top).collect():
        if r.kind == "word":
            found[r.lang]["words"][r.word] = r.n
        else:
            found[r.lang][r.kind] = r.n
    out = []
    for lang in sorted(found):
        x = found[lang]
        n, total = max(1, sum(x.get(c, 0) for c in CLASSES[:_USED])), max(1, sum(v for k, v in x.items() if k == "total"))
        out.append((lang, [x.get(c, 0) / n for c in CLASSES[:_USED]], {w: k / total for w, k in sorted(x["words"].items())}))
    return out


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
JUDGED = f"doc_id long, {COUNTS}, base_failed boolean, char_distance double, word_distance double, kept boolean"


def judge(docs: DataFrame, rules: QualityRules = QualityRules(), references: list | None = None, rows_only: bool = False) -> DataFrame:
    """Counts, distances and verdict of every document.

    A document is kept unless it fails the base (under 50 words, or over half of them in repeated windows), or its
    histogram of character classes or of common words is further from every language reference than the limit. A
    histogram under the minimum length, or without references (empty table, no lang), gives a null distance and no
    objection. A null text has no words, so fails the base.
    """
    refs = language_references(docs, rules) if references is None else references
    vocab = {w.encode(): k for k, w in enumerate(sorted({w for r in refs for w in r[2]}))}
    size = len(vocab) + 1
    ref_chars = np.array([r[1] for r in refs]).reshape(len(refs), _USED)
    ref_words = []  # of each language the places of its words, and their shares; the last place is the rest
    for _, _, shares in refs:
        at = np.array([*(vocab[w.encode()] for w in shares), size - 1], dtype=np.int64)
        ref_words.append((at, np.array([*shares.values(), max(0.0, 1 - sum(shares.values()))])))

    def table_of(texts: list[str | None]) -> list[pa.Array]:
        get, rest, n = vocab.get, size - 1, len(texts)
        counts, chars, common = [], np.zeros((n, _USED)), np.zeros((n, size), np.int32)
        for i, text in enumerate(texts):
            text = text or ""
            raw = text.encode()
            words = raw.split()
            counts.append(base_counts(text, raw, words))
            chars[i] = class_counts(raw)
            common[i] = np.bincount(np.fromiter((get(w, rest) for w in words), dtype=np.int64, count=len(words)), minlength=size)
        table = np.array(counts, dtype=np.int64).reshape(n, 5)
        far = []
        for seen, of, least in ((chars, "chars", rules.min_chars), (common, "words", rules.min_words)):
            total = seen.sum(axis=1, keepdims=True)
            short = (total[:, 0] < least) | (len(refs) == 0)
            near = np.ones(n)
            for k in range(len(refs)):  # a language at a time, by its own words
                if of == "chars":
                    d = jensen_shannon(seen / np.maximum(total, 1), ref_chars[k : k + 1])[:, 0]
                else:
                    at, q = ref_words[k]
                    p = seen[:, at] / np.maximum(total, 1)
                    d = jensen_shannon(p, q[None, :], np.maximum(0.0, (total[:, 0] > 0) - p.sum(axis=1)))[:, 0]
                near = np.minimum(near, d)
            far.append((near, short))
        failed = (table[:, 0] < 50) | (100 * table[:, 4] > 50 * table[:, 0])
        odd = [(d > most) & ~short for (d, short), most in zip(far, (rules.char_distance, rules.word_distance), strict=True)]
        return [*(pa.array(table[:, k]) for k in range(5)), pa.array(failed), *(pa.array(d, mask=s) for d, s in far), pa.array(~(failed | odd[0] | odd[1]))]

    bound_batches(docs.sparkSession)
    if rows_only:

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(table_of(batch.column("text").to_pylist())[-1])

        return docs.mapInArrow(keep, docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *table_of(batch.column(1).to_pylist())], [c.split(" ")[0] for c in JUDGED.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, JUDGED)


def keep_by_rules(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of docs, with all their columns, that judge() keeps."""
    return judge(docs, rules, rows_only=True)
