"""Quality rules as a short-circuit cascade, built-in expressions only.

Every document gets the base counts and ``base_failed``. Documents that pass the base go through further rules; each is an expression
that is true for a document to reject. What a rule costs and how many documents it rejects is estimated on a sample, and the
rules are tried in the order of rejections per cost: a CASE stops at the first that holds. The order decides how fast, never
what is kept: a document is kept when no rule holds, whatever the order.

Words are runs outside [\\x20\\x09-\\x0D]. Null and empty texts have no words and fail the base. Repeated rows get equal
results; an empty table gives an empty one. Nothing is shuffled.
"""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from waybill.llm.common import SPACE, let
from waybill.session import cut_lineage

SAMPLE_ROWS = 2_000
MIN_WORDS = 50


def _nonempty(parts: Column) -> Column:
    return F.filter(parts, lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more, the first occurrence included."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))

    def twice(ordered: Column) -> Column:
        same = F.filter(ordered, lambda x, k: (x["h"] == F.get(ordered, k - 1)["h"]) | (x["h"] == F.get(ordered, k + 1)["h"]))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    # Sorted starts: each window adds what reaches past the end of those before it.
    covered = F.aggregate(
        let(F.sort_array(windows), twice), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["n"] + x + 3 - F.greatest(x, a["end"])).alias("n"), (x + 3).alias("end")), lambda a: a["n"])
    return F.when(F.size(words) >= 3, covered).otherwise(0).cast("long")


def measure(documents: DataFrame) -> DataFrame:
    """doc_id, text, the base counts, ``n_lines`` with a word, and base_failed."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))
    # Words and lines are bound once per row: a lambda that referred to the split itself would split again at each word.
    out = documents.select("doc_id", text.alias("text")).select(
        "doc_id", "text",
        let(_nonempty(F.split("text", SPACE)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeated"))).alias("_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("all"), F.size(F.array_distinct(x)).cast("long").alias("own"))).alias("_lines"))
    n, repeated = F.col("_words.n"), F.col("_words.repeated")
    return out.select(
        "doc_id", "text", n.alias("n_words"), "word_chars", "n_symbols", (F.col("_lines.all") - F.col("_lines.own")).alias("n_dup_lines"),
        repeated.alias("n_repeat_words"), F.col("_lines.all").alias("n_lines"), ((n < MIN_WORDS) | (100 * repeated > 50 * n)).alias("base_failed"))


def _share(test: Column, of: Column, more_than: float) -> Column:
    return test > more_than * of


def _count(text: str, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(F.col(text), characters, ""))




def rules() -> dict[str, Column]:
    n = F.col("n_words")
    return {
        # As many symbols as a tenth of the words: markup or noise.
        "symbols": _share(F.col("n_symbols"), n, 0.1),
        # Mean word length of prose lies between 2 and 15 in languages with spaces.
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
        # A fifth of the words have no letter: tables, separators, numbers.
        "no_letters": _share(F.size(F.filter(F.split("text", SPACE), lambda w: (w != "") & ~w.rlike(r"\p{L}"))), n, 0.2),
        # Nearly everything upper case.
        "shouting": _share(F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")), F.col("word_chars"), 0.5),
        # Exclamation and question marks at a third of the words.
        "exclaiming": _share(_count("text", "!?"), n, 0.33),
        # A third of the lines repeat earlier ones.
        "line_repeats": _share(F.col("n_dup_lines"), F.col("n_lines"), 0.33),
        # A third of the words lie in repeated windows.
        "word_repeats": _share(F.col("n_repeat_words"), n, 0.33),
        # Three quarters of the lines end in an ellipsis.
        "ellipses": _share(F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"(\.\.\.|…)[ \t-\r]*$"))), F.col("n_lines"), 0.75),
    }


def order_rules(sample: DataFrame, candidates: Mapping[str, Column]) -> list[str]:
    """Names by rejections per second on a measured sample; rules that reject nothing come last, cheapest first."""
    figures = {}
    for name, rejects in candidates.items():
        began = time.perf_counter()
        hits = sample.agg(F.sum(F.coalesce(rejects, F.lit(False)).cast("long"))).first()[0] or 0
        figures[name] = (hits, time.perf_counter() - began)
    return sorted(figures, key=lambda k: (-figures[k][0] / figures[k][1], figures[k][1]))


def judge(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``measure`` and ``kept``: the base passed and no rule holds. About ``sample_rows`` rows decide the rules' order."""
    share = min(1.0, sample_rows / max(documents.count(), 1))
    sample = cut_lineage(measure(documents.sample(share, seed=17)).filter(~F.col("base_failed")))
    candidates = rules()
    verdict = F.when(F.col("base_failed"), False)
    for name in order_rules(sample, candidates):
        verdict = verdict.when(candidates[name], False)
    return measure(documents).withColumn("kept", verdict.otherwise(True))


def verdicts(documents: DataFrame) -> DataFrame:
    return judge(documents).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
