"""Line deduplication by repeated passages of lines.

A text is split at ``\\n``. ``remove_repeated_passages``, the query, compares three kinds of passages:

* content-defined chunks: a rolling hash over the hashes of WINDOW lines ends a chunk wherever it is 0
  modulo MODULUS and was not 0 one line earlier, so boundaries depend on the lines near them only; none is
  set before the last line, so every chunk has LEAST_LINES lines or is the whole text;
* pairs of lines with words that follow each other, with the blank lines between them: a shared passage
  of two lines or more is covered by its pairs, whatever stands around it;
* single lines of at least LONG_LINE characters.

Each that stood before in any document is removed, lines of several are removed once; the first occurrence
(smallest document id, then place in the table, then place in the text) stays, also where a repeat
overlaps it. So each removed line still stands somewhere. Passages that might be repeated are found by
64-bit hashes and confirmed by SHA-256 of their bytes.

Built-in functions only. Passages are counted by hash first, and very frequent ones are joined apart
(:func:`pathlode.llm.common.spread_join`), so one that a third of all documents hold fills no task.

Defined cases: null text has no lines, is never changed and comes back null; an empty text is one empty
line; passages without a word (blank lines) are never removed; repeated rows lose what their first has;
of rows with the same id the earlier in the table is the first, rows without id come last; lines and
texts of any length are read whole, a document's own passages in one task; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlode.llm.common import SPACES, let, materialize, spread_join

WINDOW, MODULUS, LEAST_LINES = 2, 4, 2
#: A line of so many characters is a passage by itself.
LONG_LINE = 200
CHUNK, PAIR, LINE = 0, 1, 2


def _starts(h: Column) -> Column:
    """Where the content-defined chunks of a text begin, from the hashes of its lines."""

    def of_marks(marks: Column) -> Column:
        ends = F.filter(
            F.transform(marks, lambda m, i: F.when(m & (i >= WINDOW - 1) & ((i == WINDOW - 1) | ~F.get(marks, i - 1)) & (i < F.size(marks) - LEAST_LINES), i + 1)),
            lambda e: e.isNotNull(),
        )
        return F.concat(F.array(F.lit(0)), ends)

    return let(F.transform(h, lambda x, i: F.coalesce(F.pmod(F.xxhash64(*[F.get(h, i - k) for k in range(WINDOW)]), F.lit(MODULUS)) == 0, F.lit(False))), of_marks)


def chunks(text: Column) -> Column:
    """Array of struct(no, n_lines, body): the content-defined chunks of a text, in order."""

    def cut(lines: Column) -> Column:
        def with_hashes(h: Column) -> Column:
            return let(
                _starts(h),
                lambda s: F.transform(
                    s,
                    lambda at, k: let(
                        F.slice(lines, at + 1, F.coalesce(F.get(s, k + 1), F.size(lines)) - at),
                        lambda part: F.struct(k.alias("no"), F.size(part).alias("n_lines"), F.array_join(part, "\n").alias("body")),
                    ),
                ),
            )

        return let(F.transform(lines, lambda line: F.xxhash64(line)), with_hashes)

    return F.when(text.isNotNull(), let(F.split(text, "\n"), cut)).cast("array<struct<no:int,n_lines:int,body:string>>")


def passages(text: Column) -> Column:
    """Array of struct(kind, at, n, h): chunks, pairs and long lines of a text that have a word; h is their hash."""

    def of_lines(lines: Column) -> Column:
        def of_hashes(h: Column) -> Column:
            def unit(kind: int, at: Column, n: Column) -> Column:
                return F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("at"), n.cast("int").alias("n"), F.xxhash64(F.lit(kind), F.slice(h, at + 1, n)).alias("h"))

            def of_worded(w: Column) -> Column:
                # w: numbers of the lines with a word; a chunk has one if one of them lies in it
                found = let(
                    _starts(h),
                    lambda s: F.transform(s, lambda at, k: F.struct(at.alias("at"), (F.coalesce(F.get(s, k + 1), F.size(h)) - at).alias("n"))),
                )
                blank = F.size(w) < F.size(h)
                worded = F.filter(found, lambda c: (c["n"] >= LEAST_LINES) & (~blank | F.exists(F.slice(lines, c["at"] + 1, c["n"]), _has_word)))
                pairs = F.filter(F.transform(w, lambda at, k: F.struct(at.alias("at"), (F.get(w, k + 1) - at + 1).alias("n"))), lambda c: c["n"].isNotNull())
                long = F.filter(w, lambda at: F.length(F.get(lines, at)) >= LONG_LINE)
                return F.concat(
                    F.transform(worded, lambda c: unit(CHUNK, c["at"], c["n"])),
                    F.transform(pairs, lambda c: unit(PAIR, c["at"], c["n"])),
                    F.transform(long, lambda at: unit(LINE, at, F.lit(1))),
                )

            return let(F.filter(F.transform(lines, lambda x, i: F.when(_has_word(x), i)), lambda i: i.isNotNull()), of_worded)

        return let(F.transform(lines, lambda line: F.xxhash64(line)), of_hashes)

    return F.when(text.isNotNull(), let(F.split(text, "\n"), of_lines))


def _has_word(line: Column) -> Column:
    return F.ltrim(line, F.lit(SPACES)) != ""


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_lines, n_removed_lines, n_removed_chunks, text (what is left).

    n_removed_chunks counts the content-defined chunks among the repeated passages.
    """
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    # the condition always holds; it makes the exchanges of both joins with texts alike, so that one serves both
    rows = materialize(slim.withColumn("rid", F.monotonically_increasing_id()), "lines").where("rid is not null")
    # by hashes first: which passages might be repeated, and which documents have them
    keys = materialize(rows.select("rid", F.explode(passages(F.col("text"))).alias("p")).select("rid", "p.*"), "passages")
    often = materialize(keys.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "often")
    maybe = spread_join(keys, often, ["h"], "c").groupBy("rid").agg(F.collect_list(F.struct("kind", "at", "n")).alias("maybe"))
    # then by bytes, of these passages only
    held = rows.join(maybe, "rid").select(
        "rid",
        "doc_id",
        F.explode(
            let(
                F.split("text", "\n"),
                lambda lines: F.transform("maybe", lambda m: F.struct(m["kind"].alias("kind"), m["at"].alias("at"), m["n"].alias("n"), F.unhex(F.sha2(F.array_join(F.slice(lines, m["at"] + 1, m["n"]), "\n"), 256)).alias("digest"))),
            )
        ).alias("p"),
    )
    held = materialize(held.select("rid", "doc_id", "p.*"), "held")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid", "at", "n")
    firsts = held.groupBy("kind", "digest").agg(F.count("*").alias("c"), F.min(place).alias("first")).where("c > 1")
    firsts = firsts.select("kind", "digest", "c", F.col("first.rid").alias("first_rid"), F.col("first.at").alias("first_at"), (F.col("first.at") + F.col("first.n")).alias("first_end"))
    again = spread_join(held, materialize(firsts, "firsts"), ["kind", "digest"], "c").where("rid <> first_rid or at <> first_at")
    start = F.when(F.col("rid") == F.col("first_rid"), F.greatest("at", "first_end")).otherwise(F.col("at"))
    removed = again.groupBy("rid").agg(F.collect_list(F.struct(start.alias("start"), (F.col("at") + F.col("n") - 1).alias("end"))).alias("gone"), F.count_if(F.col("kind") == CHUNK).alias("gone_chunks"))
    left = let(
        F.split("text", "\n"),
        lambda lines: let(
            F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.flatten(F.transform("gone", lambda g: F.sequence(g["start"], g["end"])))),
            lambda stay: F.struct((F.size(lines) - F.size(stay)).alias("n"), F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n").alias("text")),
        ),
    )
    cut = rows.join(removed, "rid", "left").select("doc_id", "text", "gone_chunks", F.when(F.col("gone").isNotNull(), left).alias("left"))
    return cut.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("long").alias("n_lines"),
        F.coalesce("left.n", F.lit(0)).cast("long").alias("n_removed_lines"),
        F.coalesce("gone_chunks", F.lit(0)).cast("long").alias("n_removed_chunks"),
        F.when(F.col("left").isNull(), F.col("text")).otherwise(F.col("left.text")).alias("text"),
    )
