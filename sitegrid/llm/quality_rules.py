"""Quality rules: a ledger of rule bits and measurements, to which versioned policies are applied afterwards.

Every rule is evaluated once for a text. `ledger` stores the measurements and one long whose bit r says that
rule r failed. `apply_policy` only masks that long, and `ablations` counts, for every rule of a policy, the
documents that it alone rejects: the ledger is first reduced to its distinct bit patterns (a number bounded by the
rules, not by the rows), then tested bitwise.

Defined cases: a null or empty text has no words and fails `few_words`; a null doc_id stays null; repeated rows are
judged separately; other columns of the input are ignored; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = b"#*$%&|<>"
WINDOW = 5

#: Rule names in the order of their bits. A rule fails when its SQL condition over the ledger's measurements holds.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 3 * word_chars",
    "capitals": "100 * n_upper > 45 * word_chars",
    "exclamations": "10 * n_bangs > 2 * n_words",
    "repeated_lines": "100 * n_dup_lines > 34 * n_lines",
    "stuttering": "100 * n_stutters > 25 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}


@dataclass(frozen=True)
class Policy:
    """A version of the decision: the rules that reject."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
FULL = Policy("full-1", tuple(RULES))

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs", "n_stutters"]
_UPPER = bytes(range(65, 91))


def repeat_words(words: list[bytes], k: int = WINDOW) -> int:
    """Words that lie in a k-word window found twice or more in the text, its first occurrence included."""
    n = len(words) - k + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    one = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))

    def rank(pairs: np.ndarray) -> np.ndarray:
        return np.unique(pairs, return_inverse=True)[1]

    # exact ranks of 2-, 4- and 5-word windows; a rank is below the number of words, so products fit in 64 bits
    size = len(words) + 1
    two = rank(one[:-1] * size + one[1:])
    four = rank(two[:-2] * size + two[2:])
    five = four[:-1] * size + one[4:]
    _, back, count = np.unique(five, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[back] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + k, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """The measurements of one text (UTF-8), in the order of MEASURES."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.split()
    seen: set[bytes] = set()
    dup = lines = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    joined = b"".join(words)
    upper = len(joined) - len(joined.translate(None, _UPPER))
    return (
        len(words), len(joined.decode("utf-8", "replace")), len(text) - len(text.translate(None, SYMBOLS)), dup, repeat_words(words),
        lines, upper, text.count(b"!"), sum(map(bytes.__eq__, words, words[1:])),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and fail_bits of every document; one pass without a shuffle."""

    def run(batches):
        for b in batches:
            rows = [measure(t) for t in b.column(1).to_pylist()]
            cols = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(MEASURES))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", *MEASURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    measured = docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [f"CASE WHEN {cond} THEN {1 << i}L ELSE 0L END" for i, cond in enumerate(RULES.values())]
    return measured.withColumn("fail_bits", F.expr(" + ".join(bits)))


def apply_policy(rows: DataFrame, policy: Policy, out: str = "kept") -> DataFrame:
    """Adds the verdict of a policy; the texts aren't read again."""
    return rows.withColumn(out, F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: rows that fail it, rows that only it rejects, and rows kept without it."""
    patterns = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    bits = {r: 1 << i for i, r in enumerate(RULES)}
    one = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bits[r]).cast("long").alias("bit")) for r in policy.rules]))
    per = patterns.withColumn("r", one).select("n", "r.*", F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("b"))
    rest = F.col("b").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0
    hit = F.col("b").bitwiseAND(F.col("bit")) != 0
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return per.groupBy("rule").agg(count(hit).alias("n_failed"), count(rest & hit).alias("n_only"), count(rest).alias("n_kept_without"))


def judge(docs: DataFrame, policy: Policy = FULL) -> DataFrame:
    """The ledger with base_failed and the policy's verdict `kept` (false if the base fails)."""
    rows = apply_policy(apply_policy(ledger(docs), BASE, "base_ok"), policy)
    return rows.withColumn("base_failed", ~F.col("base_ok")).withColumn("kept", F.col("kept") & F.col("base_ok")).withColumn("policy", F.lit(policy.version)).drop("base_ok")
