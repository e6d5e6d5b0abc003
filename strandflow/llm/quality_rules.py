"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule runs once per document; its measurements and one bit per failed rule are kept in a ledger.
``store`` writes the ledger without the texts to the shared folder. Versioned policies are masks over its bits and
ablations are bitwise aggregates, so on a stored ledger neither reads a text again.

Edge cases: a null text counts as empty (no words, fails ``too_few_words``); rows are judged on their
own, so repeated rows and null doc_ids change nothing, and there are no ties; a very long text is measured whole (its
arrays live in one row's memory); an empty table gives an empty ledger; other columns of the input are kept inside
``row``, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import plain, stored, unpacked

#: White space between words, as characters and as a pattern class.
SPACE, SPACE_CLASS = " \t\n\x0b\x0c\r", r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Rules in bit order: name and condition of failure over the measurements.
RULES = [
    ("too_few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "2 * n_symbols > n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 40 * n_words"),
    ("shouting", "2 * n_exclaim > n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Versioned policies: a document is rejected if it fails any rule of the mask.
POLICIES = {
    "base": BIT["too_few_words"] | BIT["repeated_windows"],
    "v1": (1 << len(RULES)) - 1,
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaim"]


def _measured(docs: DataFrame) -> DataFrame:
    """row (all input columns), and the measurements. Each step names what later lambdas use more than once."""
    strip = lambda c: F.btrim(c, F.lit(SPACE))
    # one search a character is far cheaper than a look-up of every letter
    without = lambda c, chars: F.char_length(c) - F.char_length(reduce(lambda x, ch: F.replace(x, F.lit(ch), F.lit("")), chars, c))
    df = plain(docs, "text", carry=True).select("row", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    df = df.select(
        "row",
        "t",
        F.when(strip(F.col("t")) == "", F.array().cast("array<string>")).otherwise(F.split(strip(F.col("t")), SPACE_CLASS)).alias("words"),
        F.filter(F.split("t", "\n"), lambda line: strip(line) != "").alias("lines"),
    )
    df = df.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        without(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        without(F.col("t"), "!").cast("long").alias("n_exclaim"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    keep = ["row", *[m for m in MEASURES if m != "n_repeat_words"]]

    starts = F.slice("h", F.lit(1), F.greatest(F.size("h") - (WINDOW - 1), F.lit(0)))
    key = lambda x, i: F.xxhash64(x, *[F.get("h", i + j) for j in range(1, WINDOW)])
    df = df.select(*keep, F.transform(starts, key).alias("keys"))
    # most texts repeat no window: only the others' windows are put in order
    some = F.size(F.array_distinct("keys")) < F.size("keys")
    placed = F.sort_array(F.transform("keys", lambda k, i: F.struct(k.alias("k"), i.alias("p"))))
    df = df.select(*keep, F.when(some, placed).otherwise(F.array().cast("array<struct<k:bigint,p:int>>")).alias("wins"))
    twice = F.filter("wins", lambda x, i: (F.get("wins", i - 1)["k"] == x["k"]) | (F.get("wins", i + 1)["k"] == x["k"]))
    df = df.select(*keep, F.sort_array(F.transform(twice, lambda x: x["p"])).alias("at"))
    covered = F.transform("at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("at", i + 1) - p, F.lit(WINDOW))))
    return df.select(*keep, F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x).alias("n_repeat_words"))


def ledger(docs: DataFrame) -> DataFrame:
    """``row`` (struct of the input's columns, by place: c0, c1, ...), the measurements, and ``rule_bits`` with a bit per failed rule."""
    bits = reduce(
        lambda a, b: a.bitwiseOR(b),
        [F.when(F.expr(cond), F.lit(BIT[name])).otherwise(F.lit(0)) for name, cond in RULES],
    )
    # a filter on the ledger must not be pushed below: that would put the arrays' own expressions into their lambdas
    fence = F.when(F.monotonically_increasing_id() >= 0, bits.cast("long"))
    return _measured(docs).select("row", *MEASURES, fence.alias("rule_bits"))


def store(docs: DataFrame) -> DataFrame:
    """The ledger as a written table: doc_id, the measurements and ``rule_bits``. Every policy and ablation reads this."""
    only = plain(docs, "doc_id", "text")
    return stored(ledger(only).select(F.col("row.c0").alias("doc_id"), *MEASURES, "rule_bits"), "ledger")


def passes(policy: str = "v1") -> Column:
    """True where a ledger row fails no rule of the policy."""
    return F.col("rule_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(book: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of the policy: documents that fail it, and those that only it rejects (kept if the rule were dropped)."""
    mask = POLICIES[policy]
    sums = book.groupBy(F.col("rule_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).cast("long").alias("bit")) for n, _ in RULES if BIT[n] & mask]))
    return (
        sums.select("bits", "n", rules.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("only_this"),
        )
    )


def keep_good(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The documents that pass the policy, with the input's columns."""
    return unpacked(ledger(docs).filter(passes(policy)), docs)
