"""Quality rules learned as a decision list.

Statistics of each text are counted in one pass. From labelled statistics, sequential covering learns an ordered list of rules for
the texts to drop: a rule is a conjunction of thresholds, grown on two thirds of the rows by information gain and
pruned on the other third, and rows it covers leave the set (as in IREP and RIPPER; Fürnkranz and Widmer 1994, Cohen 1995).
The list is emitted as one ordered Spark conditional expression.

The list is learned from at most TRAIN labelled documents, chosen by a hash of the id. Every document is judged on the
statistics of its whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import sample
from .textkernel import blocks, same_spans, settled, span_hashes, splitmix, window_hashes

TRAIN = 15000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks"]

_SYMBOL, _UPPER, _DIGIT, _MARK = (np.isin(np.arange(256), list(x)) for x in (b"#*$%&|<>", bytes(range(65, 91)), b"0123456789", b"!?"))


def plain_counts(text: bytes) -> tuple[int, int]:
    """Lines with a word equal to an earlier line, and words in 3-word windows found twice or more."""
    lines, words = [x for x in text.split(b"\n") if x.split()], text.split()
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(lines) - len(set(lines)), len(covered)


def statistics(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`carry` and the COUNTS (long): words, code points in words, symbols, lines equal to an earlier line, words in 3-word windows found twice or more, lines with a word, A-Z, digits, ! and ?."""
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(batch.num_columns - 1)):
                data, row, h = block.data, block.row_of_word(), block.hashes()
                n = block.last - block.first
                own = splitmix(np.arange(n, dtype=np.uint64))
                point = (data & 0xC0) != 0x80
                inside = np.zeros(len(data) + 1, dtype=np.int64)
                inside[block.starts] += 1
                inside[block.ends] -= 1
                inside = np.cumsum(inside)[:-1] > 0
                # Lines: cut at \n and at the ends of rows.
                cut = np.flatnonzero(data == 10)
                starts = np.sort(np.concatenate([block.offsets[:-1], cut + 1]))
                owner = np.searchsorted(block.offsets[1:], starts, side="right")
                edge = np.append(starts[1:], len(data))
                ends = np.where(np.isin(edge, block.offsets) & ~np.isin(edge - 1, cut), edge, edge - 1)
                ends = np.where(np.isin(edge - 1, cut), edge - 1, ends)
                owner = np.minimum(owner, n - 1)
                ends = np.maximum(np.minimum(ends, block.offsets[owner + 1]), starts)
                words = np.searchsorted(block.starts, ends) - np.searchsorted(block.starts, starts)
                some = words > 0
                starts, ends, owner = starts[some], ends[some], owner[some]
                line = span_hashes(data, starts, ends) ^ own[owner]
                n_lines = np.bincount(owner, minlength=n)
                _, first, of = np.unique(line, return_index=True, return_inverse=True)
                n_dup = n_lines - np.bincount(owner[first], minlength=n)
                again = np.flatnonzero(first[of] != np.arange(len(of)))
                lead = first[of[again]]
                wrong = [owner[again[~(same_spans(data, starts, ends, again, lead) & (owner[again] == owner[lead]))]]]
                windows = window_hashes(h, 3)
                at = np.flatnonzero(np.arange(len(windows)) + 3 <= block.row_end_of_word()[: len(windows)])
                _, first, of, count = np.unique(windows[at] ^ own[row[at]], return_index=True, return_inverse=True, return_counts=True)
                again, lead = at[count[of] > 1], at[first[of[count[of] > 1]]]
                alike = row[again] == row[lead]
                for k in range(3):
                    alike &= h[again + k] == h[lead + k]
                used = np.unique(np.concatenate([again, again + 1, again + 2]))
                _, first, of = np.unique(h[used], return_index=True, return_inverse=True)
                wrong += [row[again[~alike]], row[used[~same_spans(data, block.starts, block.ends, used, used[first[of]])]]]
                covered = np.zeros(len(h) + 3, dtype=bool)
                for k in range(3):
                    covered[again + k] = True
                repeated = block.word_sums(covered[: len(h)])
                for r in np.unique(np.concatenate(wrong)).tolist():  # hashes that collide: count by the words themselves
                    n_dup[r], repeated[r] = plain_counts(data[block.offsets[r] : block.offsets[r + 1]].tobytes())
                found = [block.n_words, block.row_sums(point & inside), block.row_sums(_SYMBOL[data]), n_dup, repeated, n_lines, block.row_sums(_UPPER[data]), block.row_sums(_DIGIT[data]), block.row_sums(_MARK[data])]
                rows = batch.slice(block.first, n)
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *[pa.array(np.asarray(x).astype(np.int64)) for x in found]], names=[*carry, *COUNTS])

    schema = "".join(f"`{c}` {fields[c]}, " for c in carry) + ", ".join(f"{c} long" for c in COUNTS)
    return docs.select(*carry, F.col(text).alias("_text")).mapInArrow(settled(run), schema)


#: Features over the counts, as (name, numerator, denominator); a denominator of 0 counts as 1. All are shares, so that a
#: text's length alone never decides.
FEATURES = [
    ("chars_per_word", "word_chars", "n_words"),
    ("symbols_per_word", "n_symbols", "n_words"),
    ("dup_line_share", "n_dup_lines", "n_lines"),
    ("repeat_share", "n_repeat_words", "n_words"),
    ("upper_share", "n_upper", "word_chars"),
    ("digit_share", "n_digits", "word_chars"),
    ("marks_per_word", "n_marks", "n_words"),
]


def feature_column(name: str) -> Column:
    _, top, bottom = next(f for f in FEATURES if f[0] == name)
    return F.col(top) / F.greatest(F.col(bottom), F.lit(1)).cast("double")


@dataclass
class Rule:
    """Texts whose features satisfy all tests (feature, is at least, threshold) are dropped."""

    tests: list[tuple[str, bool, float]]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), dtype=bool)
        for name, least, cut in self.tests:
            out &= (x[name] >= cut) if least else (x[name] < cut)
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, least, cut in self.tests:
            out = out & ((feature_column(name) >= cut) if least else (feature_column(name) < cut))
        return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int = 4) -> Rule:
    """Add the test of best FOIL gain until no good row is covered."""
    tests: list[tuple[str, bool, float]] = []
    held = np.ones(len(bad), dtype=bool)
    while len(tests) < most and (~bad[held]).any():
        p0, n0 = int(bad[held].sum()), int((~bad[held]).sum())
        best: tuple[float, tuple[str, bool, float]] | None = None
        for name, values in x.items():
            v, order = values[held], np.argsort(values[held], kind="stable")
            v, y = v[order], bad[held][order]
            change = np.flatnonzero(v[1:] > v[:-1])
            if not len(change):
                continue
            below_p, below = np.cumsum(y)[change], change + 1
            for least, p, t in ((False, below_p, below), (True, p0 - below_p, len(v) - below)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / t) - np.log2(p0 / (p0 + n0))), -1.0)
                k = int(np.argmax(gain))
                if best is None or gain[k] > best[0] + 1e-12:
                    best = (float(gain[k]), (name, least, float((v[change[k]] + v[change[k] + 1]) / 2)))
        if best is None or best[0] <= 0:
            break
        tests.append(best[1])
        held &= Rule([best[1]]).covers(x)
    return Rule(tests)


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    c = rule.covers(x)
    p, n = int((c & bad).sum()), int((c & ~bad).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: dict[str, np.ndarray], bad: np.ndarray, least_precision: float = 0.9, most: int = 24, seed: int = 11) -> list[Rule]:
    """The rules for the rows marked bad, in order; a rule whose precision on the pruning rows is below least_precision ends the search."""
    rng, rules = np.random.default_rng(seed), []
    x, bad = {k: v.copy() for k, v in x.items()}, bad.copy()
    misses = 0
    while bad.any() and len(rules) < most and misses < 3:
        part = rng.random(len(bad)) < 2 / 3
        if not bad[part].any():
            break
        rule = _grow({k: v[part] for k, v in x.items()}, bad[part])
        prune = {k: v[~part] for k, v in x.items()}
        best, kept = _worth(rule, prune, bad[~part]), rule
        for size in range(len(rule.tests) - 1, 0, -1):
            value = _worth(Rule(rule.tests[:size]), prune, bad[~part])
            if value >= best:
                best, kept = value, Rule(rule.tests[:size])
        covered = kept.covers(x)
        if not kept.tests or (best + 1) / 2 < least_precision or not (covered & bad).any():
            misses += 1
            continue
        rules.append(kept)
        x, bad = {k: v[~covered] for k, v in x.items()}, bad[~covered]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True for the texts to keep: the rules in order, and true where none applies."""
    if not rules:
        return F.lit(True)
    out = F.when(rules[0].column(), False)
    for rule in rules[1:]:
        out = out.when(rule.column(), False)
    return out.otherwise(True)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = TRAIN) -> list[Rule]:
    """Rules from the statistics of at most `limit` labelled documents; label 0 is bad."""
    rows = sample(docs, labels, label, F.lit(True), limit)
    table = statistics(rows, ("order", "label")).orderBy("order").toPandas()
    if not len(table):
        return []
    x = {}
    for name, top, bottom in FEATURES:
        x[name] = table[top].to_numpy(float) / np.maximum(table[bottom].to_numpy(float), 1)
    return learn(x, table["label"].to_numpy() == 0)


def base_rule(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, the COUNTS and base_failed, as `judge` has them; nothing is learned."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return statistics(docs.select("doc_id", "text")).withColumn("base_failed", failed)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, the COUNTS, base_failed, kept.

    base_failed: fewer than 50 words, or more than half of the words in repeated 3-word windows. kept is false where
    base_failed, else the verdict of the learned list. Null and empty texts have zeros throughout. Without labels the list is
    empty and keeps all. Repeated rows are judged each; an empty table gives an empty result; other columns are ignored.
    """
    rules = fit(docs, labels)
    return base_rule(docs).withColumn("kept", ~F.col("base_failed") & verdict(rules))


#: The counts and the base rule; the learned list is beyond SQL.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
  w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
  p AS (SELECT rid, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM w),
  g AS (SELECT rid, pos, list(word) OVER f AS h, count(*) OVER f AS n FROM p WINDOW f AS (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
  s AS (SELECT rid, pos, n = 3 AND count(*) OVER (PARTITION BY rid, h, n) > 1 AS again FROM g),
  c AS (SELECT rid, max(again::INT) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS covered FROM s),
  r AS (SELECT rid, sum(covered)::BIGINT AS n_repeat_words FROM c GROUP BY rid),
  a AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN r USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a
"""
