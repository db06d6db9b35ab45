"""Quality rules: a table of thresholds compiled into one Spark projection.

Every rule is a row ``(name, metric, relation, bound)``. The metrics are lengths, symbol shares,
stop-word shares and line ratios, all of them Spark expressions over the text column; no
user function runs. Words are runs of characters other than space and U+0009 to U+000D.

Defined results: null and empty texts have no words and fail the length rule; rows that repeat
are judged one by one; null ids stay null; columns other than the id and the text are ignored by
``quality_metrics`` and carried along by ``filter_quality``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import let

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to a in that is was for it with as on be at by this are from "
    "der die das und den dem des von zu mit für auf nicht ist ein eine sich im "
    "le la les de des du un une et est que qui dans pour par sur au avec "
    "el los las del y en se con una por para su al lo como más"
).split()


@dataclass(frozen=True)
class Rule:
    name: str
    metric: str
    relation: str  # "min": the metric has to reach the bound; "max": it may not pass it
    bound: float


#: The method's own table. Bounds are wide: a text has to be far from prose to be refused.
RULES = (
    Rule("mean_word_short", "mean_word_chars", "min", 1.5),
    Rule("mean_word_long", "mean_word_chars", "max", 25.0),
    Rule("symbol_share", "symbol_ratio", "max", 0.02),
    Rule("stop_word_share", "stop_ratio", "min", 0.04),
    Rule("capital_share", "capital_ratio", "max", 0.30),
    Rule("repeated_lines", "dup_line_ratio", "max", 0.50),
    Rule("stuttering", "stutter_ratio", "max", 0.30),
)


@dataclass(frozen=True)
class QualityConfig:
    min_words: int = 20
    max_repeat_percent: int = 30
    rules: tuple[Rule, ...] = field(default=RULES)


def _split_words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _with_next(width: int):
    """Hashes of runs of ``width`` words become those of twice as many; the last ones run over the end."""
    return lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + width)))


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of eight words found twice or more. The hashes of windows are
    compared as a set first; only texts with a repeat sort them and measure the union of the
    repeated windows from the distances between neighbours, so the cost is n log n."""

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            twice = F.filter(
                p,
                lambda x, i: F.coalesce(F.get(p, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False)),
            )
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        def length(s: Column) -> Column:
            return F.aggregate(
                F.transform(s, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - x, F.lit(WINDOW)))),
                F.lit(0),
                lambda a, x: a + x,
            )

        return let(let(pairs, starts), length)

    def over(w: Column) -> Column:
        hashed = F.transform(w, lambda x: F.xxhash64(x))
        for width in (1, 2, 4):  # hashes of two words, of four, of eight
            hashed = let(hashed, _with_next(width))
        windows = F.slice(hashed, F.lit(1), F.size(w) - (WINDOW - 1))
        return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))

    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(let(words, over))


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))


def _measured(text: Column):
    def row(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).alias("n_stop"),
            F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False)))).alias("n_stutter"),
            _dup_lines(text).alias("lines"),
            F.regexp_count(text, F.lit(r"\p{Lu}")).alias("n_capitals"),
        )

    return row


def _verdict(config: QualityConfig):
    def row(x: Column) -> Column:
        metrics = {
            "mean_word_chars": x["word_chars"] / F.greatest(x["n_words"], F.lit(1)),
            "symbol_ratio": x["n_symbols"] / F.greatest(x["word_chars"], F.lit(1)),
            "stop_ratio": x["n_stop"] / F.greatest(x["n_words"], F.lit(1)),
            "capital_ratio": x["n_capitals"] / F.greatest(x["word_chars"], F.lit(1)),
            "stutter_ratio": x["n_stutter"] / F.greatest(x["n_words"], F.lit(1)),
            "dup_line_ratio": x["lines"]["n_dup_lines"] / F.greatest(x["lines"]["n_lines"], F.lit(1)),
        }
        failed = (x["n_words"] < config.min_words) | (100 * x["n_repeat_words"] > config.max_repeat_percent * x["n_words"])
        broken = [F.when((metrics[r.metric] < r.bound) if r.relation == "min" else (metrics[r.metric] > r.bound), F.lit(r.name)) for r in config.rules]
        return F.struct(
            x["n_words"],
            x["word_chars"],
            x["n_symbols"],
            x["lines"]["n_dup_lines"].cast("long").alias("n_dup_lines"),
            x["n_repeat_words"],
            failed.alias("base_failed"),
            (~failed & (F.size(F.array_compact(F.array(*broken))) == 0)).alias("kept"),
            *[v.alias(k) for k, v in metrics.items()],
            F.array_join(F.array_compact(F.array(*broken)), ",").alias("broken_rules"),
        )

    return row


def judgement(text: Column, config: QualityConfig = QualityConfig()) -> Column:
    """All measures, ratios and verdicts of a text as one struct. It is one expression in which every
    part stands once, so a filter on it computes nothing twice."""
    text = F.coalesce(text, F.lit(""))
    return let(let(_split_words(text), _measured(text)), _verdict(config))


def quality_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: QualityConfig = QualityConfig()) -> DataFrame:
    """One row per input row: the id, the base measures, both verdicts, the ratios of the method
    and the names of the rules that the text breaks."""
    return docs.select(F.col(id_col).alias("id"), judgement(F.col(text_col), config).alias("q")).select(F.col("id").alias(id_col), "q.*")


def filter_quality(docs: DataFrame, text_col: str = "text", config: QualityConfig = QualityConfig()) -> DataFrame:
    """The rows that are kept, with the input's own columns."""
    return docs.filter(let(judgement(F.col(text_col), config), lambda q: q["kept"]))
