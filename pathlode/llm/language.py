"""Language identification by interpolated Kneser-Ney character models.

One model for each language: lower-cased letters with their combining marks, every run of other
characters one space. Order ORDER (2 at least) with absolute discounting; lower orders count the contexts in which a
character follows (continuation counts), as Kneser and Ney have it, down to a uniform distribution over
all code points. An n-gram is a 64-bit hash of its code points, so no alphabet has to
fit anywhere. A language's model is a few sorted arrays of such hashes, for each order those of its
n-grams (with their interpolated probabilities) and of its contexts (with their back-off weights); they
are built by one task for each language and found by binary search.

A text's language is the one with the lowest cross-entropy by character. The score is calibrated: a
logistic curve over the margin between the best two languages and over the cross-entropy's excess over
what is usual for the best one, both times the root of the text's length, gives the chance that the
answer is right. It is fitted on labelled rows that the models have not seen. Each of them is scored
twice, with all languages and with its own one left out: the second answer is wrong and stands for texts
in languages that were never labelled; all these together weigh UNLISTED times as much as the rows.
A text whose score is below 0.5 is marked as rejected; the prediction is returned all the same.

Fitting uses about ``max_rows`` labelled rows for each language at most (a documented bound), chosen by a
hash of the id (of the text, where the id is null); their whole texts are used. So a model's size is
bounded by ``max_rows``, and the size of all models grows with the number of n-grams that were seen, not
with that times the number of languages. Predicting uses whole texts and looks at nothing but the text;
a very long one is scored in pieces of PIECE characters that overlap by what the order needs.

Defined cases: a null text, or one without any letter, is ``und`` with score 0; without labelled rows
every text is ``und``; with one language only, that is the answer; equal cross-entropies go to the
language that comes first by name; repeated rows are each returned; an empty table gives no rows; rows
with a null id are used and returned like all others; other columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlode.llm.common import materialize
from pathlode.llm.shingles import mix

ORDER, DISCOUNT, MAX_ROWS = 4, 0.75, 2000
UNKNOWN = "und"
#: Characters of a text that are scored at a time, and texts whose n-grams are looked up together.
PIECE, TOGETHER = 1 << 20, 512
#: Weight of the answers for a hidden language against the answers for all languages, in fitting the score.
UNLISTED = 0.25
_U = np.uint64
_SPREAD = 0x9E3779B97F4A7C15
#: Characters over which the lowest order is uniform: all code points.
CODE_POINTS = 0x110000
_UNSEEN = 255
_kind = np.full(CODE_POINTS, _UNSEEN, dtype=np.uint8)


def _kinds(codes: np.ndarray) -> np.ndarray:
    """For each code: 2 for a letter, 1 for a combining mark, else 0; a process looks each code point up once."""
    found = _kind[codes]
    if (found == _UNSEEN).any():
        for c in np.unique(codes[found == _UNSEEN]).tolist():
            _kind[c] = {"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0)
        found = _kind[codes]
    return found


def normal_codes(text: str | None) -> np.ndarray:
    """Code points of the lower-cased letters and their marks, with one 32 for each run of anything else.

    Starts and ends with 32. Empty if there is no letter.
    """
    if not text:
        return np.empty(0, dtype=np.uint32)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    kind = _kinds(codes)
    if not (kind == 2).any():
        return np.empty(0, dtype=np.uint32)
    letter = kind > 0
    codes = np.where(letter, codes, np.uint32(32))[letter | np.r_[True, letter[:-1]]]
    if codes[0] != 32:
        codes = np.r_[np.uint32(32), codes]
    return codes if codes[-1] == 32 else np.r_[codes, np.uint32(32)]


def keys_of(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of each n-gram; ``columns``: its code points, the first one first."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(columns[0]), dtype=_U) + _U(len(columns))
        for c in columns:
            total = total * _U(_SPREAD) + c.astype(_U) + _U(1)
        return mix(total)


@dataclass
class Level:
    """N-grams of one order: sorted hashes, and their probabilities; the same of their contexts' weights."""

    grams: np.ndarray
    chances: np.ndarray
    heads: np.ndarray
    weights: np.ndarray

    def to_bytes(self) -> list[bytes]:
        return [x.tobytes() for x in (self.grams, self.chances, self.heads, self.weights)]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each wanted key, whether it is there) by binary search."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def fit_language(grams: np.ndarray, counts: np.ndarray, discount: float = DISCOUNT) -> list[Level]:
    """The levels, order 1 first, from distinct n-grams (rows of code points) and their counts."""
    order = grams.shape[1]
    # by order: n-grams, and how often each counts: raw at the top, below in how many left contexts it stands
    kinds = [(grams, counts.astype(np.float64))]
    for n in range(order - 1, 0, -1):
        above = kinds[0][0]
        _, first, many = np.unique(keys_of(list(above[:, 1:].T)), return_index=True, return_counts=True)
        kinds.insert(0, (above[first, 1:], many.astype(np.float64)))
    levels: list[Level] = []
    for own, c in kinds:
        n = own.shape[1]
        keys = keys_of(list(own.T))
        head = keys_of(list(own[:, :-1].T)) if n > 1 else np.zeros(len(own), dtype=_U)
        heads, back = np.unique(head, return_inverse=True)
        total, follow = np.bincount(back, weights=c), np.bincount(back)
        weights = discount * follow / total
        if n == 1:
            lower = np.full(len(own), 1 / CODE_POINTS)
        else:
            at, seen = _find(levels[-1].grams, keys_of(list(own[:, 1:].T)))
            assert seen.all()
            lower = levels[-1].chances[at]
        chances = np.maximum(c - discount, 0) / total[back] + weights[back] * lower
        place = np.argsort(keys)
        levels.append(Level(keys[place], chances[place], heads, weights))
    return levels


def chances(levels: list[Level], columns: list[np.ndarray]) -> np.ndarray:
    """Probability of each n-gram's last character after the others; ``columns`` as for :func:`keys_of`."""
    order = len(levels)
    out = np.full(len(columns[0]), 1 / CODE_POINTS)
    open_ = np.arange(len(columns[0]))
    # from the whole n-gram down: what is found has its interpolated chance, the rest backs off
    factor = np.ones(len(out))
    for n in range(order, 0, -1):
        level = levels[n - 1]
        part = [c[open_] for c in columns[order - n :]]
        at, seen = _find(level.grams, keys_of(part))
        out[open_[seen]] = factor[open_[seen]] * level.chances[at[seen]]
        open_ = open_[~seen]
        if not len(open_):
            return out
        if n > 1:
            at, known = _find(level.heads, keys_of([c[~seen] for c in part[:-1]]))
            factor[open_] *= np.where(known, level.weights[at], 1.0)
        else:
            factor[open_] *= level.weights[0]
    out[open_] = factor[open_] / CODE_POINTS
    return out


@dataclass
class Model:
    """The levels of each language; the curve of the score; each language's usual cross-entropy."""

    levels: dict[str, list[Level]] = field(default_factory=dict)
    order: int = ORDER
    curve: tuple[float, float, float] = (0.0, 1.0, 0.0)
    usual: dict[str, float] = field(default_factory=dict)

    @property
    def languages(self) -> list[str]:
        return sorted(self.levels)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(bits by character, texts x languages; number of characters scored, 0 without a letter)."""
        bits = np.zeros((len(texts), len(self.levels)))
        lengths = np.zeros(len(texts), dtype=np.int64)
        held: list[tuple[int, np.ndarray]] = []
        for i, text in enumerate(texts):
            codes = normal_codes(text)
            if not len(codes):
                continue
            lengths[i] = len(codes) - 1
            padded = np.r_[np.full(self.order - 2, 32, dtype=np.uint32), codes]
            for at in range(0, lengths[i], PIECE):
                held.append((i, padded[at : at + PIECE + self.order - 1]))
                if sum(len(p) for _, p in held) >= PIECE:
                    self._add(held, bits)
                    held = []
        if held:
            self._add(held, bits)
        bits[lengths == 0] = np.inf
        return bits / np.maximum(lengths, 1)[:, None], lengths

    def _add(self, held: list[tuple[int, np.ndarray]], bits: np.ndarray) -> None:
        if not self.levels:
            return
        long = np.array([len(p) - self.order + 1 for _, p in held])
        columns = [np.concatenate([p[k : len(p) - self.order + 1 + k] for _, p in held]) for k in range(self.order)]
        _, first, back = np.unique(keys_of(columns), return_index=True, return_inverse=True)
        distinct = [c[first] for c in columns]
        starts = np.r_[0, np.cumsum(long)[:-1]]
        owners = [i for i, _ in held]
        for j, lang in enumerate(self.languages):
            logs = -np.log2(chances(self.levels[lang], distinct))
            np.add.at(bits[:, j], owners, np.add.reduceat(logs[back], starts))

    def features(self, row: np.ndarray, n: int, hidden: int | None = None) -> tuple[int, float, float]:
        """(best language, margin to the next, excess over the usual) of a text's cross-entropies; ``hidden`` is left out."""
        if hidden is not None:
            row = row.copy()
            row[hidden] = np.inf
        best, root = int(np.argmin(row)), math.sqrt(n)
        rest = np.delete(row, best)
        margin = float(rest[np.isfinite(rest)].min() - row[best]) if np.isfinite(rest).any() else 0.0
        return best, margin * root, (float(row[best]) - self.usual.get(self.languages[best], float(row[best]))) * root

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        bits, lengths = self.entropies(texts)
        names, scores, rejected = [], [], []
        for row, n in zip(bits, lengths, strict=True):
            if not n or not self.levels:
                names.append(UNKNOWN)
                scores.append(0.0)
                rejected.append(True)
                continue
            best, margin, excess = self.features(row, int(n))
            at = self.curve[0] + self.curve[1] * margin + self.curve[2] * excess
            names.append(self.languages[best])
            scores.append(1 / (1 + math.exp(-max(-700.0, min(700.0, at)))))
            rejected.append(scores[-1] < 0.5)
        return names, scores, rejected


def gram_counts(texts: Iterator[str | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Distinct character n-grams of whole texts (rows of code points), and their counts."""
    padding = np.full(order - 2, 32, dtype=np.uint32)
    columns: list[list[np.ndarray]] = [[] for _ in range(order)]
    for codes in map(normal_codes, texts):
        padded = np.r_[padding, codes] if len(codes) else codes
        for k in range(order):
            columns[k].append(padded[k : max(k, len(padded) - order + 1 + k)])
    whole = [np.concatenate(c) if c else np.empty(0, dtype=np.uint32) for c in columns]
    _, first, counts = np.unique(keys_of(whole), return_index=True, return_counts=True)
    return np.stack([c[first] for c in whole], axis=1), counts


def _count_batches(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_language: dict[str, list] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by_language.setdefault(lang, []).append(text)
            for lang, texts in by_language.items():
                grams, counts = gram_counts(iter(texts), order)
                packed = [g.tobytes() for g in grams]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(packed), pa.string()), pa.array(packed, pa.binary()), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])

    return run


def _fit_group(order: int, discount: float):
    def run(table: pa.Table) -> pa.Table:
        grams = np.frombuffer(b"".join(table.column("gram").to_pylist()), dtype=np.uint32).reshape(-1, order)
        levels = fit_language(grams, table.column("n").to_numpy(), discount)
        lang = table.column("lang")[0].as_py()
        rows = [(lang, n, *level.to_bytes()) for n, level in enumerate(levels, 1)]
        names = ["lang", "n", "grams", "chances", "heads", "weights"]
        return pa.table({c: pa.array([r[i] for r in rows], pa.string() if i == 0 else pa.int32() if i == 1 else pa.binary()) for i, c in enumerate(names)})

    return run


def _calibration_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = model.languages
        for batch in batches:
            rows = []
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                bits, lengths = model.entropies(part.column("text").to_pylist())
                for lang, row, n in zip(part.column("lang").to_pylist(), bits, lengths, strict=True):
                    if not n or lang not in model.levels:
                        continue
                    own = names.index(lang)
                    best, margin, _ = model.features(row, int(n))
                    hidden, hidden_margin, _ = model.features(row, int(n), own) if len(names) > 1 else (None, 0.0, 0.0)
                    rows.append((lang, int(n), names[best], float(row[best]), margin, None if hidden is None else names[hidden], None if hidden is None else float(row[hidden]), hidden_margin))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.string(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["lang", "n", "best", "bits", "margin", "hidden", "hidden_bits", "hidden_margin"])

    return run


_CALIBRATION = "lang string, n long, best string, bits double, margin double, hidden string, hidden_bits double, hidden_margin double"


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[float, ...]:
    """Weighted logistic regression by Newton's method; a ridge on standardised features keeps it finite."""
    middle, scale = np.average(x, axis=0, weights=weight), x.std(axis=0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - middle) / scale]
    ridge = np.diag([1e-6] + [1e-2 * weight.sum() / 100] * x.shape[1])
    b = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -60, 60)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - ridge @ b)
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        b += step
        if np.abs(step).max() < 1e-9:
            break
    slopes = b[1:] / scale
    return (float(b[0] - slopes @ middle), *map(float, slopes))


def calibrate(model: Model, rows: list) -> None:
    """Each language's usual cross-entropy, and the curve of the score, from rows that the models have not seen.

    ``rows``: as many as a tenth of the fitted sample at most, numbers and names only.
    """
    right = [r for r in rows if r.best == r.lang]
    for lang in model.languages:
        own = [r.bits for r in right if r.lang == lang]
        if own:
            model.usual[lang] = float(np.median(own))
    if not rows:
        return
    excess = lambda bits, lang, n: (bits - model.usual.get(lang, bits)) * math.sqrt(n)
    x = [(r.margin, excess(r.bits, r.best, r.n)) for r in rows]
    y = [float(r.best == r.lang) for r in rows]
    hidden = [r for r in rows if r.hidden is not None]
    x += [(r.hidden_margin, excess(r.hidden_bits, r.hidden, r.n)) for r in hidden]
    weight = np.r_[np.ones(len(rows)), np.full(len(hidden), UNLISTED * len(rows) / max(1, len(hidden)))]
    # one wrong answer in the middle keeps the curve finite where all answers are right
    x.append(tuple(np.median(np.array(x), axis=0)))
    model.curve = fit_curve(np.array(x), np.r_[y, np.zeros(len(hidden) + 1)], np.r_[weight, 1.0])


def train(labelled: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = MAX_ROWS, order: int = ORDER) -> Model:
    """Fit on rows with a language. At most about ``max_rows`` rows of each language are used: those whose
    hash of the id lies below the share that gives so many. A tenth of them only calibrates."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).where("lang is not null")
    rows = rows.withColumn("id", F.coalesce("id", F.concat(F.lit("="), "text"), F.lit("null")))
    totals = rows.groupBy("lang").agg(F.count("*").alias("c")).collect()  # one row for each language
    shares = {r.lang: min(1.0, max_rows / r.c) for r in totals}
    share = F.create_map(*[F.lit(x) for pair in sorted(shares.items()) for x in pair])[F.col("lang")] if shares else F.lit(0.0)
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < share)
    tenth = F.pmod(F.xxhash64(F.lit("tenth"), F.col("id")), F.lit(10)) == 0
    counted = sample.where(~tenth).select("lang", "text").mapInArrow(_count_batches(order), "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    fitted = counted.groupBy("lang").applyInArrow(_fit_group(order, DISCOUNT), "lang string, n int, grams binary, chances binary, heads binary, weights binary")
    model = Model(order=order)
    for r in materialize(fitted, "language-models").orderBy("lang", "n").toLocalIterator():
        arrays = [np.frombuffer(r[c], dtype=_U if c in ("grams", "heads") else np.float64) for c in ("grams", "chances", "heads", "weights")]
        model.levels.setdefault(r.lang, []).append(Level(*arrays))
    if model.levels:
        shared = spark.sparkContext.broadcast(model)
        told = sample.where(tenth).select("lang", "text").mapInArrow(_calibration_rows(shared), _CALIBRATION)
        calibrate(model, sorted(told.collect()))
        shared.unpersist()
    return model


def _predictor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names, scores, rejected = [], [], []
            for at in range(0, batch.num_rows, TOGETHER):
                n, s, r = model.predict(batch.column("text").slice(at, TOGETHER).to_pylist())
                names += n
                scores += s
                rejected += r
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*kept, "lang_pred", "score", "rejected"],
            )

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """One row for each document: doc_id, the columns of ``extra`` (booleans), lang_pred, score, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), *[c.alias(n) for n, c in (extra or {}).items()])
    names = "".join(f", {n} boolean" for n in (extra or {}))
    return slim.mapInArrow(_predictor(shared), f"doc_id long{names}, lang_pred string, score double, rejected boolean")


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))
