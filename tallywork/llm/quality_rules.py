"""Quality rules as a ledger of failure bits, and policies over it; DataFrame functions only."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.llm.common import let, page_texts
from tallywork.session import write_scratch

SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``fails`` is an SQL condition on the measurements; ``bit`` is its fixed place in the ledger."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 10 * n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
    Rule(6, "capitals", "100 * n_capitals > 40 * word_chars"),
    Rule(7, "exclamations", "100 * n_exclamations > 20 * n_words"),
)

#: Versioned policies: the rules that a page must pass. A version is never changed, only superseded.
POLICIES = {
    1: ("few_words", "repeated_words"),
    2: tuple(rule.name for rule in RULES),
}


def policy_mask(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    bits = {rule.name: rule.bit for rule in rules}
    return sum(1 << bits[name] for name in set(names))


def _count_of(characters: str) -> Column:
    return F.length("html") - F.length(F.translate("html", characters, ""))


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window which the text holds twice or more.

    The window hashes are sorted with their places, so that equal ones are neighbours; the places of
    repeated windows, sorted again, are walked once, each adding the words it doesn't share with the last.
    """

    def windows(word_hash: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(word_hash) - 3)
        return F.sort_array(F.transform(starts, lambda i: F.struct(
            F.xxhash64(F.get(word_hash, i), F.get(word_hash, i + 1), F.get(word_hash, i + 2)).alias("h"), i.alias("i"))))

    def repeated(window: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            return F.coalesce(F.get(window, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(
                F.get(window, k + 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(window, twin), lambda x: x["i"]))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("words"))
        return F.aggregate(places, start, lambda so_far, i: F.struct(
            i.alias("last"), (so_far["words"] + F.least(F.lit(3), i - so_far["last"])).alias("words")))["words"]

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    measured = let(let(let(hashes, windows), repeated), covered)
    return F.when(F.size(words) >= 3, measured).otherwise(0)


def measure(pages: DataFrame) -> DataFrame:
    """(page_id, measurements) of each row of ``pages(page_id, html)``.

    n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words as their names say: words are runs without
    space, tab or line break characters; a duplicate line has a word and equals an earlier line; repeated words lie
    in 3-word windows found twice or more. n_lines counts lines with a word; n_capitals upper-case letters;
    n_exclamations the character ``!``. Missing and empty texts measure 0 throughout.

    All within the row, without a shuffle: sorting inside arrays keeps a text of n words at n log n steps.
    """
    split = page_texts(pages).select(
        "page_id", "html",
        F.array_remove(F.split("html", f"{SPACE_CLASS}+"), "").alias("words"),
        F.filter(F.split("html", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    counts = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.translate("html", SPACES, "")),
        "n_symbols": _count_of(SYMBOLS),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": _repeat_words(F.col("words")),
        "n_lines": F.size("lines"),
        "n_capitals": F.length("html") - F.length(F.regexp_replace("html", r"\p{Lu}+", "")),
        "n_exclamations": _count_of("!"),
    }
    return split.select("page_id", *(c.cast("long").alias(name) for name, c in counts.items()))


def rules_version(rules: Sequence[Rule] = RULES) -> str:
    """A digest of the rules: their bits, names and conditions. Bits of one version mean nothing under another."""
    return hashlib.sha256("\n".join(f"{r.bit} {r.name} {r.fails}" for r in sorted(rules, key=lambda r: r.bit)).encode()).hexdigest()[:16]


def rule_ledger(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(page_id, measurements, failure_bits, rules_version): every rule evaluated once and written to the scratch area.

    Bit ``rule.bit`` is set where the page fails the rule; ``rules_version`` says by which rules. Policies and ablations read this table alone, so that
    a change of policy never touches a text again. Repeated rows have repeated entries.
    """
    bits = [F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long") for rule in rules]
    together = bits[0]
    for bit in bits[1:]:
        together = together.bitwiseOR(bit)
    return write_scratch(measure(pages).withColumns({
        "failure_bits": together, "rules_version": F.lit(rules_version(rules))}), "rule_ledger")


def _bits_of(rules: Sequence[Rule]) -> Column:
    """The failure bits; a row whose bits were set by other rules fails the query."""
    return F.when(F.col("rules_version") == rules_version(rules), F.col("failure_bits")).otherwise(
        F.raise_error(F.concat(F.lit("the ledger is of other rules: "), F.col("rules_version"))).cast("long"))


def apply_policy(ledger: DataFrame, policy: Sequence[str], rules: Sequence[Rule] = RULES) -> DataFrame:
    """``ledger`` with ``kept``: true where none of the policy's bits is set. A ledger of other ``rules`` is an error."""
    return ledger.withColumn("kept", _bits_of(rules).bitwiseAND(F.lit(policy_mask(policy, rules))) == 0)


def ablations(ledger: DataFrame, policy: Sequence[str], rules: Sequence[Rule] = RULES) -> DataFrame:
    """(rule, n_failed, n_failed_alone, n_kept, n_kept_without) for each rule of the policy.

    ``n_kept_without`` is what the policy would keep if the rule were dropped. The ledger shrinks to its distinct
    bit patterns first, at most two to the number of rules; the rest works on those.
    """
    mask = policy_mask(policy, rules)
    patterns = ledger.groupBy(_bits_of(rules).bitwiseAND(F.lit(mask)).alias("bits")).agg(
        F.count(F.lit(1)).alias("pages"))

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("pages"))), F.lit(0)).cast("long")

    chosen = [rule for rule in rules if rule.name in policy]
    table = patterns.agg(total(F.col("bits") == 0).alias("kept"), *(c for rule in chosen for c in (
        total(F.col("bits").bitwiseAND(F.lit(1 << rule.bit)) != 0).alias(f"failed_{rule.bit}"),
        total(F.col("bits") == (1 << rule.bit)).alias(f"alone_{rule.bit}"))))
    rows = F.array(*(F.struct(
        F.lit(rule.name).alias("rule"), F.col(f"failed_{rule.bit}").alias("n_failed"),
        F.col(f"alone_{rule.bit}").alias("n_failed_alone"), F.col("kept").alias("n_kept"),
        (F.col("kept") + F.col(f"alone_{rule.bit}")).alias("n_kept_without")) for rule in chosen))
    return table.select(F.inline(rows))
