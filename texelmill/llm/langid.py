"""Language identification with one interpolated Kneser-Ney character model per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from texelmill.llm import bpe, words
from texelmill.llm.words import U
from texelmill.session import cut_lineage

ORDER = 4
#: Labelled documents per language that are learned from, at most; a fifth of them calibrate.
MOST_DOCS = 2000
#: A document is rejected beyond so many times its language's TAIL quantile of the calibration documents' deviations; that counts as no more than MOST_TAIL
#: times the BULK quantile, so that junk among the labelled rows, up to what lies beyond BULK, doesn't set the limit.
SLACK, TAIL, BULK, MOST_TAIL = 6.0, 0.99, 0.95, 3.0
#: The quantiles of fewer calibration rows say little: such a language's limit is not below that of the rows of all languages.
FEW = 100
#: Characters whose evidence the score counts: longer texts aren't surer than that.
EVIDENCE = 20
UNKNOWN = "und"
_BLANK = 0x20


def _lower_table() -> np.ndarray:
    if "lower" not in _tables:
        low = np.arange(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            if not 0xD800 <= i < 0xE000 and len(c := chr(i).lower()) == 1:
                low[i] = ord(c)
        low[bpe.classes() != bpe.LETTER] = _BLANK
        _tables["lower"] = low
    return _tables["lower"]


_tables: dict[str, np.ndarray] = {}


def letters(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of consecutive texts, runs of anything else as one blank, ORDER - 1 blanks ahead of each; and where each text begins."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    size = np.ones(len(points), np.int8)
    for least in (0x80, 0x800, 0x10000):
        size += points >= least
    byte = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    begin = np.searchsorted(byte, at)
    padded = np.insert(_lower_table()[points], np.repeat(begin[:-1], ORDER - 1), _BLANK)
    head = begin + np.arange(len(begin)) * (ORDER - 1)
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != _BLANK) | (padded[:-1] != _BLANK)
    if len(begin) > 1:
        keep[(head[:-1, None] + np.arange(ORDER - 1)).ravel()] = True
    return padded[keep], np.concatenate(([0], np.cumsum(keep)))[head]


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of grams given as columns of characters, first character first."""
    out = np.full(len(columns[0]), len(columns), U)
    for c in columns:
        out = words.mix(out * U(0x9E3779B97F4A7C15) + c.astype(U))
    return out


@dataclass
class KneserNey:
    """Sorted hash arrays per order k: grams with their interpolated log probability, contexts with the log weight of the lower order."""

    grams: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    weight: list[np.ndarray] = field(default_factory=list)
    floor: float = 0.0

    @classmethod
    def fit(cls, grams: np.ndarray, counts: np.ndarray) -> KneserNey:
        """grams: (n, ORDER) different character rows; counts: how often each occurs."""
        levels = [(grams, counts.astype(np.float64))]
        for k in range(ORDER - 1, 0, -1):  # how many different characters come before each shorter gram
            short, n = np.unique(levels[-1][0][:, 1:], axis=0, return_counts=True)
            levels.append((short, n.astype(np.float64)))
        levels.reverse()
        out = cls()
        alphabet = len(levels[0][0]) + 1
        lower: dict[tuple, float] = {}
        out.floor = -np.log(alphabet)
        for k, (rows, n) in enumerate(levels, start=1):
            once, twice = (n == 1).sum(), (n == 2).sum()
            discount = once / (once + 2 * twice) if once else 0.5
            context, of = np.unique(rows[:, :-1], axis=0, return_inverse=True) if k > 1 else (np.zeros((1, 0), rows.dtype), np.zeros(len(rows), np.int64))
            of = of.ravel()
            total = np.bincount(of, n, len(context))
            kinds = np.bincount(of, minlength=len(context))
            weight = discount * kinds / total
            base = np.array([lower[tuple(r)] for r in rows[:, 1:].tolist()]) if k > 1 else np.full(len(rows), 1 / alphabet)
            p = np.maximum(n - discount, 0) / total[of] + weight[of] * base
            lower = dict(zip(map(tuple, rows.tolist()), p.tolist()))
            for keys, values, key_list, value_list in ((rows, p, out.grams, out.logp), (context, weight, out.contexts, out.weight)):
                h = gram_hash(list(keys.T)) if keys.shape[1] else np.zeros(1, U)
                order = np.argsort(h)
                key_list.append(h[order])
                value_list.append(np.log(np.maximum(values, 1e-300))[order])
        return out

    def score(self, columns: list[np.ndarray]) -> np.ndarray:
        """Log probability of the last character of each gram after those before it."""
        n = len(columns[0])
        out, open_ = np.zeros(n), np.ones(n, bool)
        for k in range(ORDER, 0, -1):
            own = columns[ORDER - k :]
            at = _find(self.grams[k - 1], h := gram_hash(own))
            hit = open_ & (self.grams[k - 1][at] == h)
            out[hit] += self.logp[k - 1][at[hit]]
            open_ &= ~hit
            h = gram_hash(own[:-1]) if k > 1 else np.zeros(n, U)
            at = _find(self.contexts[k - 1], h)
            known = open_ & (self.contexts[k - 1][at] == h)
            out[known] += self.weight[k - 1][at[known]]
        out[open_] += self.floor
        return out


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return np.minimum(np.searchsorted(table, keys), len(table) - 1)


@dataclass
class Identifier:
    """Models by language (code-point order) and, per language, the calibrated mean and deviations of the cross-entropy of its own texts."""

    langs: list[str]
    models: list[KneserNey]
    center: np.ndarray
    spread: np.ndarray
    limit: np.ndarray

    def entropies(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) cross-entropy in nats a character, and the characters scored. Texts without a letter have none."""
        chars, begin = letters(data, at)
        count = np.diff(begin) - (ORDER - 1)
        place = np.arange(count.sum()) + np.repeat(begin[:-1] + (ORDER - 1) - np.concatenate(([0], np.cumsum(count)))[:-1], count)
        out = np.zeros((len(count), len(self.langs)))
        if len(place):
            columns = [chars[place - j] for j in range(ORDER - 1, -1, -1)]
            code, _ = pd.factorize(gram_hash(columns))
            some = np.empty(code.max() + 1, np.int64)
            some[code] = np.arange(len(code))
            few = [c[some] for c in columns]
            filled = np.flatnonzero(count)
            first = np.concatenate(([0], np.cumsum(count[filled])))[:-1]
            for i, model in enumerate(self.models):
                out[filled, i] = -np.add.reduceat(model.score(few)[code], first) / count[filled]
        has = np.add.reduceat(np.append(chars != _BLANK, False), begin[:-1]) > 0 if len(chars) else np.zeros(len(count), bool)
        return out, np.where(has & (np.diff(begin) > 0), count, 0)

    def deviation(self, entropy: np.ndarray, lang: np.ndarray, count: np.ndarray) -> np.ndarray:
        """How far above its language's mean a text of that length is; long texts vary less."""
        return (entropy - self.center[lang]) / (self.spread[lang] * np.sqrt(0.1 + EVIDENCE / np.maximum(count, 1)))


def sample(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = MOST_DOCS, key: Column | None = None) -> DataFrame:
    """(text, lang, calibrate): at most ``most`` different labelled texts of each language, those of the smallest hash.

    A hash below a share that leaves a few more than ``most`` thins out large languages before rows are ranked, so no language is gathered. Rows of one text and
    label count as one, in the share too: repeats go where they are read, before anything is ranked.
    """
    key = F.xxhash64(text, lang, F.lit("langid")) if key is None else key
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), key.alias("key")).where("text is not null and lang is not null and text <> ''")
    same = F.xxhash64("text", "lang")
    # one row per language, as many as there are models on every worker; rows are thinned out where they are read
    different = rows.groupBy("lang", same.alias("same")).agg(F.min("key").alias("key"))
    counts = F.broadcast(different.groupBy("lang").agg(F.count("*").alias("n")).withColumnRenamed("lang", "l"))
    place = (F.col("key").cast("double") + 2.0**63) / 2.0**64
    thin = rows.join(counts, F.col("lang") == F.col("l")).where(place * F.col("n") < most + 6 * most**0.5)
    thin = thin.groupBy("lang", same.alias("same")).agg(F.min(F.struct("key", "text")).alias("first")).select("lang", "first.key", "first.text")
    ranked = thin.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("key", "text"))).where(F.col("rank") <= most)
    return ranked.select("text", "lang", (F.pmod(F.col("rank"), F.lit(5)) == 0).alias("calibrate"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = MOST_DOCS, key: Column | None = None) -> Identifier:
    """Learns from a bounded sample of labelled rows (see :func:`sample`); rows without text or label teach nothing.

    Character grams are counted on the executors; the driver gets the counts of different grams, bounded by the sample. Four fifths of the sample
    give the counts, one fifth the median, the spread and the limit of each language's cross-entropy, by the rows that are least surprising under their own label.
    """
    rows = cut_lineage(sample(docs, text, lang, most, key))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, own in batch.to_pandas().groupby("lang"):
                data, at = words.text_buffer(pa.array(own["text"], pa.string()))
                for a, b in words.pieces(at):
                    chars, begin = letters(data[at[a] : at[b]], at[a : b + 1] - at[a])
                    size = np.diff(begin) - (ORDER - 1)
                    place = np.arange(size.sum()) + np.repeat(begin[:-1] + (ORDER - 1) - np.concatenate(([0], np.cumsum(size)))[:-1], size)
                    if len(place):
                        grams, n = np.unique(np.stack([chars[place - j] for j in range(ORDER - 1, -1, -1)], 1), axis=0, return_counts=True)
                        texts = grams.astype("<u4").tobytes().decode("utf-32-le")
                        strings = [texts[i : i + ORDER] for i in range(0, len(texts), ORDER)]
                        yield pa.RecordBatch.from_pydict({"lang": [label] * len(n), "gram": strings, "n": n})

    schema = "lang string, gram string, n long"
    counts = rows.where("not calibrate").mapInArrow(count, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    models = []
    for label in langs:
        own = counts[counts["lang"] == label].sort_values("gram")
        grams = np.frombuffer("".join(own["gram"]).encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
        models.append(KneserNey.fit(grams, own["n"].to_numpy()))
    found = Identifier(langs, models, np.zeros(len(langs)), np.ones(len(langs)), np.full(len(langs), np.inf))
    if not langs:
        return found

    def own_entropy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = words.text_buffer(batch.column("text"))
            label = batch.column("lang").to_pylist()
            for a, b in words.pieces(at):
                entropy, n = found.entropies(data[at[a] : at[b]], at[a : b + 1] - at[a])
                of = np.array([langs.index(x) if x in langs else -1 for x in label[a:b]], np.int64)
                good = (of >= 0) & (n > 0) & (entropy.argmin(axis=1) == of)  # a row that another language fits better is no example of its label
                yield pa.RecordBatch.from_pydict({"lang": of[good], "n": n[good], "entropy": entropy[good, of[good]]})

    seen = rows.select("text", "lang", "calibrate").where("calibrate").mapInArrow(own_entropy, "lang long, n long, entropy double").toPandas()
    for i in range(len(langs)):
        own = seen[seen["lang"] == i].sort_values(["entropy", "n"])
        if len(own) < 5:  # too few to tell: nothing is rejected
            continue
        found.center[i] = own["entropy"].median()
        found.spread[i] = max((own["entropy"] - found.center[i]).abs().median(), 0.02)
    known = seen[found.center[seen["lang"]] > 0]
    far, of = found.deviation(known["entropy"].to_numpy(), known["lang"].to_numpy(), known["n"].to_numpy()), known["lang"].to_numpy()
    for i in np.unique(of):
        own = far[of == i]
        found.limit[i] = _limit(own) if len(own) >= FEW else max(_limit(own), _limit(far))  # deviations are in units of each language's spread
    return found


def _limit(far: np.ndarray) -> float:
    tail, bulk = np.quantile(far, [TAIL, BULK], method="lower")
    return max(SLACK * min(tail, MOST_TAIL * max(bulk, 1.0)), 10.0)


def identify(docs: DataFrame, found: Identifier, text: str = "text") -> DataFrame:
    """The same rows plus ``lang_pred`` string, ``score`` double, ``cross_entropy`` double, ``rejected`` boolean (own columns of these names are replaced).

    The language of least cross-entropy a character, ties to the first by code point. ``score`` is its share of the likelihoods of at most EVIDENCE
    average characters. A null text, one without a letter, or any text when nothing was learned, is ``und`` with score 0, rejected, without cross-entropy. Other
    texts are rejected when their cross-entropy deviates from their language's median by more than that language's limit (see SLACK). A language with fewer than
    five calibration rows has no limit.
    Whole texts are read; each row is decided on its own, so copies agree and order doesn't matter.
    """
    added = ["lang_pred", "score", "cross_entropy", "rejected"]
    rest = docs.drop(*added)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = words.text_buffer(batch.column(text))
            for a, b in words.pieces(at, 2 * words.PIECE_BYTES):
                if found.langs:
                    entropy, n = found.entropies(data[at[a] : at[b]], at[a : b + 1] - at[a])
                else:
                    entropy, n = np.zeros((b - a, 1)), np.zeros(b - a, np.int64)
                best = entropy.argmin(axis=1)
                least = entropy.min(axis=1)
                share = 1 / np.exp(-(entropy - least[:, None]) * np.minimum(n, EVIDENCE)[:, None]).sum(axis=1)
                known = n > 0
                odd = ~known | (found.deviation(least, best, n) > found.limit[best] if found.langs else True)
                part = batch.slice(a, b - a)
                columns = [
                    pa.array([found.langs[i] if k else UNKNOWN for i, k in zip(best.tolist(), known.tolist())], pa.string()),
                    pa.array(np.where(known, share, 0.0)),
                    pa.array(least, mask=~known),
                    pa.array(odd),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *added])

    schema = T.StructType(list(rest.schema.fields))
    for name, kind in zip(added, ("string", "double", "double", "boolean")):
        schema.add(name, kind)
    return rest.mapInArrow(predict, schema)
