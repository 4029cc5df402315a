"""Quality rules: a ledger of failure bits, read by versioned policies.

Every rule is evaluated once per document.  The ledger keeps the measurements
and one bit per failed rule in ``fail_bits``; a policy is only a pair of masks,
so a new policy, or the effect of leaving a rule out, is computed from the
ledger without reading a text again.

Defined cases: a null or blank text has no words and zero in every measurement
(it fails ``few_words``); repeated rows give repeated ledger rows; an empty
table gives an empty ledger; a value equal to a limit passes, as every rule asks
for more or less.  All columns of the input stay, but one named like a measurement
or ``fail_bits`` is replaced.  Very long texts are measured whole: linear in the
text except for one sort of the window hashes, which only texts that repeat a
window pay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsdrift.llm.common import SPACE_CLASS, unused, words

WINDOW = 5  # words of a window for repeated passages


@dataclass(frozen=True)
class Rule:
    name: str
    bit: int
    fails: str  # SQL condition over the measurements


@dataclass(frozen=True)
class Policy:
    """Rejects a document that fails a rule of ``hard``, or more than
    ``max_soft`` rules of ``soft``."""

    version: str
    hard: tuple[str, ...]
    soft: tuple[str, ...] = ()
    max_soft: int = 0


RULES = (
    Rule("few_words", 0, "n_words < 10"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > n_words"),
    Rule("duplicate_lines", 3, "2 * n_dup_lines > n_lines"),
    Rule("word_length", 4, "2 * word_chars < 5 * n_words or word_chars > 14 * n_words"),
    Rule("capitals", 5, "2 * n_upper > n_letters"),
    Rule("exclamations", 6, "10 * n_exclaim > 3 * n_words"),
    Rule("few_letters", 7, "2 * n_letters < word_chars"),
)

POLICIES = (
    Policy("base", ("few_words", "repeated_words")),
    Policy("strict", tuple(r.name for r in RULES)),
    Policy("production", ("few_words", "repeated_words", "symbols", "duplicate_lines", "exclamations"),
           ("word_length", "capitals", "few_letters"), 0),
)
PRODUCTION = POLICIES[2]


def mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: 1 << r.bit for r in rules}
    return sum(bits[n] for n in set(names))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements of ``text`` (all long).

    n_repeat_words counts the words inside windows of five words that occur at
    least twice: windows are compared by a 64-bit hash, the repeated positions
    are sorted, and each adds the words up to the next one, five at most."""
    t = F.coalesce(F.col(text), F.lit(""))
    keep = docs.columns
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
             "n_upper", "n_letters", "n_exclaim")
    keep = [f"`{c}`" for c in keep if c.lower() not in names]
    n_word, n_line, n_symbol, n_bang, n_up, n_letter, n_hash, n_sorted, n_at = unused(
        docs.columns, "__words", "__lines", "__symbols", "__exclaim", "__upper", "__letters", "__hash", "__sorted", "__at")

    def left(pattern: str) -> Column:
        return F.length(F.regexp_replace(t, pattern, ""))

    one = docs.select(
        *keep,
        words(F.col(text)).alias(n_word),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]")).alias(n_line),
        left(r"[^#*$%&|<>]+").alias(n_symbol),
        left(r"[^!]+").alias(n_bang),
        left(r"\P{Lu}+").alias(n_up),
        left(r"\P{L}+").alias(n_letter),
    )
    w = F.col(n_word)
    two = one.select(
        "*",
        F.when(
            F.size(w) >= WINDOW,
            F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW),
                        lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])),
        ).otherwise(F.array().cast("array<bigint>")).alias(n_hash),
    )
    h = F.col(n_hash)
    repeats = F.size(F.array_distinct(h)) < F.size(h)
    none = F.array().cast("array<struct<hash:bigint,at:int>>")
    three = two.select(
        *keep, n_word, n_line, n_symbol, n_bang, n_up, n_letter,
        F.when(repeats, F.sort_array(F.transform(
            h, lambda x, i: F.struct(x.alias("hash"), i.alias("at"))))).otherwise(none).alias(n_sorted),
    )
    s = F.col(n_sorted)

    def twin(e: Column, k: Column) -> Column:
        # get() with an index of -1 is null, as past the end
        return F.coalesce(F.get(s, k - 1)["hash"] == e["hash"], F.lit(False)) | F.coalesce(
            F.get(s, k + 1)["hash"] == e["hash"], F.lit(False))

    four = three.select(
        *keep, n_word, n_line, n_symbol, n_bang, n_up, n_letter,
        F.sort_array(F.transform(F.filter(s, twin), lambda e: e["at"])).alias(n_at),
    )
    at = F.col(n_at)
    covered = F.aggregate(
        F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1), x + WINDOW) - x)),
        F.lit(0), lambda a, x: a + x)
    lines = F.col(n_line)
    values = (
        F.size(w), F.length(F.array_join(w, "")), F.col(n_symbol), F.size(lines),
        F.size(lines) - F.size(F.array_distinct(lines)), covered,
        F.col(n_up), F.col(n_letter), F.col(n_bang),
    )
    return four.select(*keep, *[v.cast("long").alias(n) for n, v in zip(names, values, strict=True)])


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measurements of every row plus ``fail_bits``: bit ``r.bit`` is set when
    rule ``r`` fails."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measure(docs.drop("fail_bits"), text).withColumn("fail_bits", bits)


def passes(policy: Policy, bits: Column | str = "fail_bits", rules: tuple[Rule, ...] = RULES) -> Column:
    b = F.col(bits) if isinstance(bits, str) else bits
    hard = b.bitwiseAND(F.lit(mask(policy.hard, rules)).cast("long")) == 0
    soft = F.bit_count(b.bitwiseAND(F.lit(mask(policy.soft, rules)).cast("long"))) <= policy.max_soft
    return hard & soft


def apply_policies(book: DataFrame, policies=POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with one boolean column ``kept_<version>`` per policy."""
    return book.select("*", *[passes(p, rules=rules).alias(f"kept_{p.version}") for p in policies])


def ablations(book: DataFrame, policies=POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per policy and rule it uses: documents and words that fail the rule,
    that the policy keeps, and that it would keep too without the rule.

    The ledger is first counted per bit pattern (at most 2^rules rows after the
    map-side combine), so the policies never touch the documents again."""
    patterns = book.groupBy("fail_bits").agg(F.count("*").alias("docs"), F.sum("n_words").alias("words"))
    cases = []
    for p in policies:
        for r in rules:
            if r.name in p.hard + p.soft:
                without = Policy(p.version, tuple(n for n in p.hard if n != r.name),
                                 tuple(n for n in p.soft if n != r.name), p.max_soft)
                cases.append(F.struct(
                    F.lit(p.version).alias("policy"), F.lit(r.name).alias("rule"),
                    (F.col("fail_bits").bitwiseAND(F.lit(1 << r.bit).cast("long")) != 0).alias("fails"),
                    passes(p, rules=rules).alias("kept"), passes(without, rules=rules).alias("kept_without")))
    long = patterns.select("docs", "words", F.explode(F.array(*cases)).alias("c")).select("docs", "words", "c.*")

    def total(what: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")

    gained = ~F.col("kept") & F.col("kept_without")
    return long.groupBy("policy", "rule").agg(
        total("docs", F.col("fails")).alias("docs_failing"),
        total("docs", F.col("kept")).alias("docs_kept"),
        total("docs", gained).alias("docs_gained"),
        total("words", gained).alias("words_gained"))


def keep_passing(docs: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """The rows of ``docs`` that ``policy`` keeps, columns unchanged.

    The filter also reads a column the optimizer may not move a filter past;
    below the ledger it would repeat every measurement per use."""
    book = ledger(docs.select(F.struct("*").alias("row"), F.col("text"))).withColumn("__part", F.spark_partition_id())
    return book.where(passes(policy) & (F.col("__part") >= 0)).select("row.*")
