"""Line-first quality rules, in DataFrame functions only.

Each line of a text is judged by punctuation, navigation and boilerplate rules. Failing lines are
removed; a document that loses too much of its text that way is rejected. Before that, base rules on
the number of words and on repeated five-word windows apply to the whole text.

Null text counts as a text without words: all counts are 0, it fails the base rules. Repeated rows
are judged each on its own; an empty table gives an empty result. Columns of the input other than the text are passed on
untouched. A text is held in memory as five arrays (words, their hashes, windows, lines, good lines), some ten times its size;
nothing is cut off.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, quoted, whole_row, words_on_white_space

#: Characters that count as symbols. A fixed value of the contract.
SYMBOLS = "#*$%&|<>"
#: Marks that pile up in shouted or decorated lines.
NOISE = SYMBOLS + "!?=~^_"
#: A line of prose has a sentence that ends in it, or ends with such a mark itself; marks of scripts that put no space behind them
#: count anywhere, and scripts without such marks by a run of letters.
PROSE = (
    r"[.!?…][\x22')\]”’»]*(?:[\x20\x09-\x0D]|\z)|[。！？｡؟۔।॥។။།።։]|[:;\x22')\]”’»」』][\x20\x09-\x0D]*\z"
    r"|[ก-ฺเ-๎ກ-ຽເ-ໝ]{12}"
)
HAS_WORD = r"[^\x20\x09-\x0D]"
#: Phrases of licence, cookie, login and sharing lines, in lower case.
BOILERPLATE = (
    "all rights reserved", "licensed under", "public license", "terms of use", "terms of service", "privacy policy", "use cookies", "uses cookies", "accept cookies",
    "cookie settings", "cookie policy", "enable javascript", "subscribe to our", "our newsletter", "sign up for", "log in to", "click here", "read more", "share this", "powered by", "lorem ipsum",
)


@dataclass(frozen=True)
class QualityLimits:
    min_words: int = 10
    max_repeat_percent: int = 20
    #: Noise marks in a line, per hundred characters.
    max_noise_percent: int = 10
    #: Separators " | ", " > ", " » ", " · " in a line.
    max_separators: int = 2
    #: Characters of a line that one phrase of boilerplate condemns: a longer line that mentions it stays.
    phrase_reach: int = 80
    #: Characters in removed lines, per hundred characters in lines.
    max_lost_percent: int = 50


def keyed_windows(hashes: Column, windows: Column) -> Column:
    """(w, v, i) of each five-word window, sorted: hashes of 64 and 32 bits, both of the words' own 64-bit hashes, and the position.

    Windows whose words differ in their 64-bit hashes are taken for equal only if both hashes of the window meet; equal windows are
    neighbours.
    """
    return F.array_sort(
        F.transform(windows, lambda w, i: F.struct(w.alias("w"), F.hash(*[F.get(hashes, i + k) for k in range(5)]).alias("v"), i.alias("i")))
    )


def _covered(at: Column) -> Column:
    """Words covered by five-word windows that start at the sorted positions ``at``."""
    gaps = F.transform(at, lambda p, k: F.when(k == 0, F.lit(5)).otherwise(F.least(F.lit(5), p - F.get(at, k - 1))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)


SEPARATORS = (" | ", " > ", " » ", " · ")


def count_of(text: Column, marks: str) -> Column:
    return F.length(text) - F.length(F.translate(text, marks, ""))


def is_prose(line: Column) -> Column:
    """What ``PROSE`` says; most lines show it by their last character."""
    return line.endswith(".") | line.endswith("!") | line.endswith("?") | line.rlike(PROSE)


def may_offend(text: Column, lowered: Column) -> Column:
    """Whether any line of a text can fail for more than its prose: a phrase, a separator or a noise mark stands in it somewhere."""
    found = [F.contains(lowered, F.lit(x)) for x in BOILERPLATE] + [F.contains(text, F.lit(x)) for x in SEPARATORS]
    return (count_of(text, NOISE) > 0) | reduce(lambda a, b: a | b, found)


def line_passes(line: Column, limits: QualityLimits, lowered: Column | None = None) -> Column:
    """``lowered``: the line in lower case, where it is at hand; each phrase would lower it again."""
    low = F.lower(line) if lowered is None else lowered
    separators = sum(((F.length(line) - F.length(F.replace(line, F.lit(s), F.lit("")))) / 3 for s in SEPARATORS), F.lit(0))
    phrases = reduce(lambda a, b: a + b, [F.contains(low, F.lit(x)).cast("int") for x in BOILERPLATE])
    return (
        is_prose(line)
        & (count_of(line, NOISE) * 100 <= limits.max_noise_percent * F.length(line))
        & (separators <= limits.max_separators)
        & (phrases * limits.phrase_reach < F.length(line))
    )


def judge(docs: DataFrame, text: str = "text", limits: QualityLimits = QualityLimits()) -> DataFrame:
    """All columns of ``docs`` and: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept,
    cleaned_text (the text without the lines that fail), lost_chars, line_chars (long). These replace input columns of
    the same names."""
    t, w, h, win, keyed, at, lines, low, good, said = (free_name(docs, f"_q_{x}") for x in ("text", "words", "hashes", "windows", "keyed", "at", "lines", "low", "good", "said"))
    df = docs.withColumn(t, F.coalesce(F.col(quoted(text)), F.lit("")))
    df = df.withColumn(w, words_on_white_space(F.col(t)))
    df = df.withColumn(low, F.lower(F.col(t)))
    df = df.withColumn(said, may_offend(F.col(t), F.col(low)))
    df = df.withColumn(low, F.when(F.col(said), F.split(low, "\n")))
    df = df.withColumn(lines, F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike(HAS_WORD)))
    df = df.withColumn(h, F.transform(F.col(w), lambda x: F.xxhash64(x)))
    hashes = F.col(h)
    df = df.withColumn(
        win,
        F.when(
            F.size(hashes) >= 5,
            F.transform(F.slice(hashes, F.lit(1), F.size(hashes) - 4), lambda x, i: F.xxhash64(x, *[F.get(hashes, i + k) for k in range(1, 5)])),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    df = df.withColumn(
        keyed,
        F.when(
            F.size(F.array_distinct(F.col(win))) < F.size(win),
            keyed_windows(hashes, F.col(win)),
        ),
    )
    k = F.col(keyed)

    def same(x: Column, y: Column) -> Column:
        return F.coalesce((x["w"] == y["w"]) & (x["v"] == y["v"]), F.lit(False))

    df = df.withColumn(
        at,
        F.sort_array(F.transform(F.filter(k, lambda x, i: same(x, F.get(k, i - 1)) | same(x, F.get(k, i + 1))), lambda x: x["i"])),
    )
    lowered = F.col(low)
    # in most texts no line can offend: they are judged by their prose alone
    plain = F.filter(F.col(lines), is_prose)
    searched = F.filter(F.split(F.col(t), "\n"), lambda x, i: x.rlike(HAS_WORD) & line_passes(x, limits, F.get(lowered, i)))
    df = df.withColumn(good, F.when(F.col(said), searched).otherwise(plain))
    total = lambda c: F.coalesce(F.length(F.array_join(c, "")), F.lit(0)).cast("long")
    df = df.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": total(F.col(w)),
            "n_symbols": F.when(F.col(said), count_of(F.col(t), SYMBOLS)).otherwise(0).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(F.col(lines)))).cast("long"),
            "n_repeat_words": F.when(F.size(at) > 0, _covered(F.col(at))).otherwise(F.lit(0)).cast("long"),
            "line_chars": total(F.col(lines)),
            "lost_chars": total(F.col(lines)) - total(F.col(good)),
            "cleaned_text": F.array_join(F.col(good), "\n"),
        }
    )
    df = df.withColumn(
        "base_failed", (F.col("n_words") < limits.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * limits.max_repeat_percent)
    )
    lost_too_much = F.col("lost_chars") * 100 > F.col("line_chars") * limits.max_lost_percent
    return df.withColumn("kept", ~F.col("base_failed") & ~lost_too_much).drop(t, w, h, win, keyed, at, lines, low, good, said)


def keep_good(docs: DataFrame, text: str = "text", limits: QualityLimits = QualityLimits()) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns and the texts they came with, whatever their names."""
    packed = docs.select(whole_row(docs).alias("_row"), F.col(quoted(text)).alias("_text"))
    # the row number keeps the filter above the projections: pushed down, it would repeat all of their work
    judged = judge(packed, "_text", limits).withColumn("_place", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("_place") >= 0)).select("_row.*")
