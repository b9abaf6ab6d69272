"""Quality rules as weak supervision.

Each rule looks at measures of a document's whole text and votes: +1 (good), -1 (bad) or 0 (abstains).
Votes of all documents are counted by pattern; expectation-maximisation over these counts estimates each
rule's accuracy and the share of good documents, without labels. A document's posterior probability of
being good, not an all-must-pass filter, decides.

Everything is a built-in function or an aggregate. The counts are of all documents; their number is at
most 3 to the number of rules, whatever the input's size, so EM runs over them in the driver.

Defined cases: null and empty texts have no words and every count 0; such documents fail the base rules;
an empty table gives no rows (EM then keeps its starting values); repeated rows are judged alike; a
posterior of exactly one half keeps the document; a text is measured whole in one task, in time n log n;
other columns are ignored by :func:`measure` and kept by :func:`filter_quality`, whatever their names.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlode.llm.common import SPACE_CLASS, SPACES, let, materialize, words

SYMBOLS = "#*$%&|<>"


def _has_word(line: Column) -> Column:
    return F.length(F.translate(line, SPACES, "")) > 0


def repeat_words(tokens: Column) -> Column:
    """Words that lie in a 3-word window which occurs at least twice in the text, the first included.

    Windows are compared by a 64-bit hash; only texts in which one repeats are sorted for positions.
    """

    def covered(hashes: Column) -> Column:
        def starts(ordered: Column) -> Column:
            twice = F.filter(
                F.transform(
                    ordered,
                    lambda x, i: F.when((F.get(ordered, i - 1)["h"] == x["h"]) | (F.get(ordered, i + 1)["h"] == x["h"]), x["i"]),
                ),
                lambda p: p.isNotNull(),
            )
            return let(
                F.sort_array(twice),
                lambda p: F.aggregate(
                    F.transform(p, lambda at, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - at, F.lit(3)))),
                    F.lit(0),
                    lambda total, n: total + n,
                ),
            )

        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(F.sort_array(pairs), starts))

    windows = let(
        tokens,
        lambda w: F.when(
            F.size(w) >= 3,
            F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    return let(windows, covered)


def measure(docs: DataFrame, text: str = "text") -> Column:
    """Struct of the counts that rules use, all over the whole text."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))

    def counts(tokens: Column) -> Column:
        return F.struct(F.size(tokens).cast("long").alias("n_words"), F.size(F.array_distinct(tokens)).cast("long").alias("n_distinct"), repeat_words(tokens).cast("long").alias("n_repeat_words"))

    lines = F.filter(F.split(body, "\n"), _has_word)
    by_word = let(words(body), counts)
    by_line = let(lines, lambda ls: F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines")))
    chars = F.length(F.translate(body, SPACES, ""))
    return F.struct(
        by_word.alias("w"),
        by_line.alias("l"),
        chars.cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(body) - F.length(F.translate(body, "!?", ""))).cast("long").alias("n_exclaim"),
        F.length(F.regexp_replace(body, r"[^\p{L}\p{N}]+", "")).cast("long").alias("n_alnum"),
        F.length(F.regexp_replace(body, r"\P{Lu}+", "")).cast("long").alias("n_upper"),
    )


@dataclass(frozen=True)
class Rule:
    """A vote: ``good`` and ``bad`` are SQL conditions over the measures; when neither holds it abstains."""

    name: str
    good: str
    bad: str

    def vote(self) -> Column:
        return F.when(F.expr(self.bad), F.lit(-1)).when(F.expr(self.good), F.lit(1)).otherwise(F.lit(0))


#: Conditions over n_words, n_distinct, word_chars, n_alnum, n_symbols, n_lines, n_dup_lines, n_repeat_words,
#: n_exclaim and n_upper. Rules that look for a defect only vote when they see it; each defect is seen by two.
RULES = (
    Rule("length", "n_words >= 100", "n_words < 50"),
    Rule("word_length", "word_chars between 3 * n_words and 9 * n_words", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    Rule("prose", "n_alnum >= 0.95 * word_chars and n_dup_lines = 0 and 100 * n_upper <= 15 * word_chars", "false"),
    Rule("symbols", "false", "100 * n_symbols > 20 * n_words"),
    Rule("letters_and_digits", "false", "n_alnum < 0.93 * word_chars"),
    Rule("repeated_lines", "false", "100 * n_dup_lines > 30 * n_lines"),
    Rule("repeated_windows", "false", "100 * n_repeat_words > 30 * n_words"),
    Rule("distinct_words", "false", "n_distinct < 0.2 * least(n_words, 1000)"),
    Rule("capitals", "false", "100 * n_upper > 40 * word_chars"),
    Rule("exclamations", "false", "100 * n_exclaim > 30 * n_words"),
)

#: base_failed of the plain rules: too short, or mostly repeated.
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents; each rule's chance of every vote given a good and given a bad document."""

    prior: float
    good: tuple[tuple[float, float, float], ...]
    bad: tuple[tuple[float, float, float], ...]

    def accuracies(self) -> list[float]:
        """Chance that a rule is right when it votes."""
        out = []
        for g, b in zip(self.good, self.bad, strict=True):
            right = self.prior * g[2] + (1 - self.prior) * b[0]
            voted = self.prior * (g[0] + g[2]) + (1 - self.prior) * (b[0] + b[2])
            out.append(right / voted if voted else 0.5)
        return out

    def weights(self) -> tuple[float, list[tuple[float, float, float]]]:
        """Log odds of good: the bias, and what each rule's vote -1, 0, +1 adds."""
        return math.log(self.prior / (1 - self.prior)), [(math.log(g[0] / b[0]), 0.0, math.log(g[2] / b[2])) for g, b in zip(self.good, self.bad, strict=True)]

    def posterior(self, votes: list[Column]) -> Column:
        bias, add = self.weights()
        odds = F.lit(bias)
        for vote, (minus, none, plus) in zip(votes, add, strict=True):
            odds = odds + F.when(vote < 0, F.lit(minus)).when(vote > 0, F.lit(plus)).otherwise(F.lit(none))
        return 1 / (1 + F.exp(-odds))


#: What is believed of a rule before any votes are seen: chances of the votes -1, 0, +1 given a good and
#: given a bad document, and the share of good documents. It weighs as much as PRIOR_WEIGHT of the documents.
PRIOR_GOOD, PRIOR_BAD, PRIOR_SHARE, PRIOR_WEIGHT = (0.02, 0.18, 0.80), (0.20, 0.30, 0.50), 0.8, 0.1


def fit_label_model(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 200, tolerance: float = 1e-9) -> LabelModel:
    """EM over (votes, count) patterns: the most probable model given the votes and the prior beliefs.

    The prior gives the two classes their roles (rules are better than chance, a bad vote names a defect
    and weighs more than a good one) and keeps a rule that seldom votes from running away. Abstentions
    count in the distributions of votes but weigh nothing in a document's odds.
    """
    total = sum(n for _, n in patterns)
    base = PRIOR_WEIGHT * total or 1.0
    belief: list[float] | None = None
    model = LabelModel(PRIOR_SHARE, (PRIOR_GOOD,) * n_rules, (PRIOR_BAD,) * n_rules)
    for _ in range(rounds):
        bias, add = model.weights()
        new = [1 / (1 + math.exp(-max(-700.0, min(700.0, bias + sum(add[j][v[j] + 1] for j in range(n_rules)))))) for v, _ in patterns]
        if belief is not None and max((abs(a - b) for a, b in zip(new, belief, strict=True)), default=0.0) < tolerance:
            break
        belief = new
        good = sum(q * n for q, (_, n) in zip(belief, patterns, strict=True))
        tables = []
        for side, before in ((True, PRIOR_GOOD), (False, PRIOR_BAD)):
            table = []
            for j in range(n_rules):
                seen = [base * x for x in before]
                for q, (v, n) in zip(belief, patterns, strict=True):
                    seen[v[j] + 1] += n * (q if side else 1 - q)
                table.append(tuple(x / sum(seen) for x in seen))
            tables.append(tuple(table))
        model = LabelModel((good + base * PRIOR_SHARE) / (total + base), *tables)
    return model


_FLAT = ("w.n_words", "w.n_distinct", "word_chars", "n_alnum", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words", "n_exclaim", "n_upper")


def measures(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Two structs: ``row``, the columns ``keep`` of each document (all by default), and ``q``, its counts."""
    row = F.struct(*[F.col(f"`{c}`") for c in (keep or docs.columns)])
    raw = docs.select(row.alias("row"), measure(docs, text).alias("m"))
    return raw.select("row", F.struct(*[F.col(f"m.{c}").alias(c.split(".")[-1]) for c in _FLAT]).alias("q"))


def votes(rules: tuple[Rule, ...]) -> list[Column]:
    """The rules' votes over the columns of ``q``."""
    return [Rule(r.name, _of_q(r.good), _of_q(r.bad)).vote() for r in rules]


def _of_q(condition: str) -> str:
    return re.sub(r"\b(n_\w+|word_chars)\b", r"q.\1", condition)


def label_model(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> LabelModel:
    """Fit the label model to the votes on all rows of ``measured``."""
    names = [f"v{j}" for j in range(len(rules))]
    voted = measured.select(*[v.alias(n) for v, n in zip(votes(rules), names, strict=True)])
    counted = voted.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()
    return fit_label_model([(tuple(r[:-1]), r.n) for r in counted], len(rules))


def judge(measured: DataFrame, model: LabelModel, rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """row, q, base_failed, quality (the posterior) and kept."""
    out = measured.select("row", "q", F.expr(_of_q(BASE_FAILED)).alias("base_failed"), model.posterior(votes(rules)).alias("quality"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each document: its id, its counts, base verdict, verdict and posterior."""
    measured = materialize(measures(docs, text, [id_col]), "quality")
    judged = judge(measured, label_model(measured, rules), rules)
    return judged.select(F.col(f"row.`{id_col}`").alias(id_col), "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words", "base_failed", "kept", "quality")


def filter_quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that are kept, with the columns of ``docs``.

    Measures are written once beside the rows, so that the texts are measured once and nothing is
    joined back.
    """
    measured = materialize(measures(docs, text), "quality")
    return judge(measured, label_model(measured, rules), rules).where("kept").select("row.*")


__all__ = ["RULES", "SPACE_CLASS", "LabelModel", "Rule", "filter_quality", "fit_label_model", "judge", "label_model", "measures", "quality_report", "repeat_words"]
