"""Per-document text statistics, and text types from thresholds on them treated as noisy labelling functions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.session import staged
from corvane.sources.tables import table

TYPES = ("prose", "list", "table", "junk")
#: Words that count as common; a longer list is an error, as it would say nothing.
MOST_COMMON = 1 << 20
#: Tokens to either side over which the density of common and plain words is taken.
REACH = 6
LETTERS, DIGITS, GAP = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"\S {2,}\S")
PLAIN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+(?:[.,]\d+)*%?")
EDGE = ".,;:!?()[]{}\"'*>#«»“”‘’¿¡…-–—•_~`"
MARK = re.compile(r"\s*(?:[-*•+◦▪‣]|\(?(?:\d{1,3}|[A-Za-z]|[ivxIVX]{1,4})[.)])\s+(?:\[[ xX]\]\s*)?")
LOG = re.compile(r"\s*(?:\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|at \S+\(.*\)\s*$|File \".*\", line \d+|[0-9a-fA-F]{6,}:? +(?:[0-9a-fA-F]{2,4} ){4})")
RULE = frozenset("+-|=: \t")
PAIR = re.compile(r"[\w.-]+\s?[=:]\s?\S")
STATISTICS = {
    "n_words": "long", "n_lines": "long", "n_chars": "long", "mean_word_length": "double", "symbol_ratio": "double", "digit_ratio": "double",
    "punctuated_lines": "double", "common_words": "double", "sentence_share": "double", "sentence_lines": "double",
    "plain_words": "double", "distinct_trigrams": "double", "listed_lines": "double", "short_lines": "double", "cell_lines": "double", "pair_lines": "double",
    "entry_lines": "double", "heap_lines": "double", "log_lines": "double", "long_tokens": "double",
}


class Tokens(dict):
    """token -> what its letters say, packed into one integer and kept while tokens are many times the same: the number of
    the common word it is (0: none), whether it is a plain word or number, and its letters, digits and length."""

    def __init__(self, common: dict[str, int]):
        super().__init__()
        self.common = common

    def measured(self, token: str) -> tuple[int, int, int, int, int]:
        bare = token.lower().strip(EDGE)
        plain = bare.isalpha() or PLAIN.fullmatch(bare) is not None
        letters, digits = sum(map(len, LETTERS.findall(token))), sum(map(len, DIGITS.findall(token)))
        return self.common.get(bare, 0), int(plain), letters, digits, len(token)

    def __missing__(self, token: str) -> int:
        common, plain, letters, digits, size = self.measured(token)
        if len(self) > 500_000:
            self.clear()
        self[token] = packed = (common * 2 + plain) << 42 | letters << 28 | digits << 14 | size
        return packed

    def of(self, tokens: list[str]) -> tuple[np.ndarray, ...]:
        """The measures of all tokens as arrays."""
        if max(map(len, tokens)) >= 1 << 14:  # too long to pack
            return tuple(np.array([self.measured(t) for t in tokens], np.int64).T)
        packed = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        low = (1 << 14) - 1
        return packed >> 43, packed >> 42 & 1, packed >> 28 & low, packed >> 14 & low, packed & low


def statistics_of(text: str | None, known: Tokens) -> tuple:
    """The STATISTICS of one text, in order; of a null or blank text all are 0.

    n_chars counts characters that are not blank; the shares of lines are of such characters. sentence_share is the share
    of characters in tokens whose surroundings have common words as sentences do and are mostly plain words;
    sentence_lines is that of lines with several different common words. Both leave out a phrase from its third time on.
    The shares after plain_words, but for distinct_trigrams, are of other lines: with a list mark, short, with as many cells
    as another line, of key-value pairs, of entries between commas, of many words with nothing between them, of a log or
    trace; long_tokens is the share of tokens longer than 60 without a closing tag.
    """
    tokens = text.split() if text else []
    n = len(tokens)
    if not n:
        return (0, 0, 0) + (0.0,) * (len(STATISTICS) - 3)
    number, is_plain, letter, digit, lengths = known.of(tokens)
    is_common = (number > 0).astype(np.int64)
    chars, letters, digits = int(lengths.sum()), int(letter.sum()), int(digit.sum())
    at = np.arange(n)
    low, high = np.maximum(at - REACH, 0), np.minimum(at + REACH + 1, n)
    span = high - low
    c = np.concatenate([[0], np.cumsum(is_common)])
    p = np.concatenate([[0], np.cumsum(is_plain)])
    fluent = ((c[high] - c[low]) >= 0.15 * span) & ((p[high] - p[low]) >= 0.6 * span)
    # A phrase that comes for the third time or more is looped, not said.
    seen = Counter(zip(tokens, tokens[1:], tokens[2:]))
    fresh = np.ones(n, bool)
    if seen and max(seen.values()) > 2:
        so_far: Counter = Counter()
        for j, gram in enumerate(zip(tokens, tokens[1:], tokens[2:])):
            so_far[gram] += 1
            fresh[j] = so_far[gram] < 3
    fresh[-2:] = fresh[max(n - 3, 0)]
    sizes = np.concatenate([[0], np.cumsum(lengths)])
    said_so_far = np.concatenate([[0], np.cumsum(lengths * fresh)])
    sizes_at, said_at, common_at, numbers = sizes.tolist(), said_so_far.tolist(), c.tolist(), number.tolist()
    lines = ended = listed = short = cells = pairs = said = entries = heaps = logs = ruled = 0
    widths: dict[tuple[str, int], list[int]] = {}
    i = 0
    for line in text.split("\n"):
        k = len(line.split())
        if not k:
            continue
        lines += 1
        size, many = sizes_at[i + k] - sizes_at[i], common_at[i + k] - common_at[i]
        words = len(set(numbers[i : i + k]) - {0}) if many > 1 else many
        i += k
        last = line.rstrip()[-1]
        ended += last in ".!?:;…\"”»)"
        sentence = words >= 2 and many >= 0.12 * k
        said += (said_at[i] - said_at[i - k]) * sentence
        if sentence:
            continue
        listed += size * (MARK.match(line) is not None)
        short += size * (k <= 6 and words < 2)
        pairs += size * (("=" in line or ":" in line) and len(PAIR.findall(line)) * 2 >= k)
        logs += size * (LOG.match(line) is not None)
        commas = sum(map(line.count, (", ", "; ", " / ", " · ")))
        entries += size * (commas >= 3 and commas * 5 > k)
        if not RULE.issuperset(line):
            heaps += size * (k > 8 and commas * 6 < k and "|" not in line and "\t" not in line)
        elif k * 3 <= size:
            ruled += size
        for sep in ("|", "\t", ",", ";", "</td>"):
            if (m := line.count(sep)) >= 2:
                same = widths.setdefault((sep, m), [0, 0])
                same[0] += size
                same[1] += 1
        if "  " in line and (m := len(GAP.findall(line))) >= 2:
            same = widths.setdefault((" ", m), [0, 0])
            same[0] += size
            same[1] += 1
    cells = max((size for size, rows in widths.values() if rows > 1), default=0)
    cells += ruled * (cells > 0)
    long = sum(len(t) for t in tokens if len(t) > 60 and "</" not in t) if lengths.max() > 60 else 0
    return (
        n, lines, chars, chars / n, 1 - (letters + digits) / chars, digits / chars,
        ended / lines, float(is_common.sum() / n), float(lengths[fluent & fresh].sum() / chars), said / chars,
        float(is_plain.sum() / n), min(1.0, max(len(seen), 1) / max(1, n - 2)), listed / chars, short / chars, min(1.0, cells / chars), min(1.0, pairs / chars),
        entries / chars, heaps / chars, logs / chars, long / chars,
    )


def statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """doc_id and the STATISTICS of each document's whole text, one pass in Arrow batches, no shuffle.

    The list of common words is a fixed, small table and is sent to the tasks. Repeated doc_ids give repeated rows.
    """
    rows = common_words.select(F.lower("word")).filter(F.col("word").isNotNull()).distinct().limit(MOST_COMMON + 1).collect()
    if len(rows) > MOST_COMMON:
        raise ValueError(f"more than {MOST_COMMON} common words")
    common = {r[0]: i for i, r in enumerate(sorted(rows), 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tokens(common)
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = zip(*[statistics_of(t.as_py(), known) for t in batch.column(1)])
            arrays = [pa.array(c, pa.int64() if kind == "long" else pa.float64()) for c, kind in zip(columns, STATISTICS.values())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *STATISTICS])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{k} {v}" for k, v in STATISTICS.items()))


#: Labelling functions: a statistic and its thresholds; the vote is the number of thresholds reached.
FUNCTIONS: list[tuple[str, tuple[float, ...]]] = [
    ("sentence_share", (0.42,)), ("sentence_lines", (0.4,)), ("common_words", (0.1,)), ("distinct_trigrams", (0.5,)), ("plain_words", (0.75,)),
    ("listed_lines", (0.3,)), ("short_lines", (0.5,)), ("cell_lines", (0.3,)), ("pair_lines", (0.3,)),
    ("entry_lines", (0.3,)), ("heap_lines", (0.3,)), ("log_lines", (0.3,)), ("long_tokens", (0.5,)), ("symbol_ratio", (0.5,)), ("n_words", (1,)),
]
#: The vote patterns there can be, whatever the input: what is collected and broadcast never exceeds this.
PATTERNS = prod(len(cuts) + 1 for _, cuts in FUNCTIONS)
#: No function is taken to be surer than this for any type, so none decides against all others.
SUREST = 0.95

#: The kinds of text there are, each of a type, with what functions say of it before any data are seen: the probability of the
#: highest vote. A type such as junk is no one thing, and the votes on it agree only within a kind.
KINDS: list[tuple[str, dict[str, float]]] = [
    ("prose", {"sentence_share": 0.95, "sentence_lines": 0.95, "common_words": 0.95, "plain_words": 0.95}),
    ("list", {"listed_lines": 0.9, "short_lines": 0.8, "plain_words": 0.9}),
    ("list", {"short_lines": 0.9, "plain_words": 0.9}),
    ("list", {"entry_lines": 0.9, "plain_words": 0.9}),
    ("table", {"cell_lines": 0.95, "short_lines": 0.9, "plain_words": 0.95}),
    ("table", {"cell_lines": 0.95, "short_lines": 0.9, "plain_words": 0.1}),
    ("table", {"cell_lines": 0.95, "plain_words": 0.4}),
    ("table", {"pair_lines": 0.95, "short_lines": 0.6, "plain_words": 0.1}),
    ("junk", {"distinct_trigrams": 0.05, "plain_words": 0.9, "common_words": 0.5}),
    ("junk", {"heap_lines": 0.95, "plain_words": 0.6}),
    ("junk", {"log_lines": 0.95, "short_lines": 0.5, "plain_words": 0.1}),
    ("junk", {"long_tokens": 0.9, "short_lines": 0.5, "plain_words": 0.1}),
    ("junk", {"symbol_ratio": 0.9, "short_lines": 0.5, "plain_words": 0.1}),
    ("junk", {"plain_words": 0.2, "heap_lines": 0.2}),
    ("junk", {"n_words": 0.05, "distinct_trigrams": 0.05, "plain_words": 0.05}),
]
#: What they say where a kind does not tell.
OTHERWISE = {"distinct_trigrams": 0.95, "n_words": 0.95, "plain_words": 0.6, "common_words": 0.1}
#: How many documents of each kind that is worth.
PRIOR_WEIGHT = 10.0


def prior(kind: int, function: str) -> float:
    return KINDS[kind][1].get(function, OTHERWISE.get(function, 0.05))


def pattern() -> Column:
    """All votes as one integer below PATTERNS, in mixed base."""
    code = F.lit(0)
    for name, cuts in FUNCTIONS:
        vote = sum((F.col(name) >= c).cast("int") for c in cuts)
        code = code * F.lit(len(cuts) + 1) + vote
    return code.cast("int")


def votes(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), len(FUNCTIONS)), np.int64)
    rest = codes.astype(np.int64)
    for j in reversed(range(len(FUNCTIONS))):
        rest, out[:, j] = np.divmod(rest, len(FUNCTIONS[j][1]) + 1)
    return out


def learned(codes: np.ndarray, counts: np.ndarray, labelled: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, list[np.ndarray]]:
    """Posterior type of each vote pattern, and each function's learned table of votes per kind: expectation-maximization over the agreements of the labelling functions.

    codes, counts: the patterns and how many documents show them; labelled: of these, how many are known to be of each
    type (may be all 0). Each function has for each of KINDS a distribution over its votes, learned together with the
    shares of the kinds, and never surer than SUREST; known documents keep their type. Starts from what KINDS say, worth
    PRIOR_WEIGHT documents each.
    """
    v = votes(codes)
    free = np.maximum(counts - labelled.sum(1), 0)
    of_type = np.array([[t == name for name, _ in KINDS] for t in TYPES], float)
    start = []
    for name, cuts in FUNCTIONS:
        top = np.array([prior(k, name) for k in range(len(KINDS))])
        start.append(np.stack([(1 - top) / len(cuts)] * len(cuts) + [top], 1))
    tables, share = start, np.full(len(KINDS), 1 / len(KINDS))
    post = np.zeros((len(codes), len(KINDS)))
    for _ in range(rounds):
        score = np.log(share)[None] + sum(np.log(t[:, v[:, j]]).T for j, t in enumerate(tables))
        new = np.exp(score - score.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        # A document known to be of a type is of one of its kinds.
        mass = new * free[:, None]
        for i, n in enumerate(labelled.T):
            own = new * of_type[i] + 1e-12 * of_type[i]
            mass += own / own.sum(1, keepdims=True) * n[:, None]
        share = (mass.sum(0) + 1) / (mass.sum() + len(KINDS))
        tables = []
        for j, s in enumerate(start):
            got = np.stack([mass[v[:, j] == k].sum(0) for k in range(s.shape[1])], 1) + PRIOR_WEIGHT * s
            got = np.clip(got / got.sum(1, keepdims=True), 1 - SUREST, SUREST)
            tables.append(got / got.sum(1, keepdims=True))
        if np.abs(new - post).max(initial=0) < 1e-6:
            break
        post = new
    return (new if len(codes) else post) @ of_type.T, tables


def typed(stats: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """stats (staged) with the posterior of each type (p_prose …), text_type, the likeliest, and is_prose.

    Votes are counted per pattern over all documents, and over all labelled ones; those counts, at most PATTERNS rows, are
    what the driver learns from. A text without any word is junk whatever was learned. Labels of other names are ignored;
    of a document labelled twice both labels count.
    """
    coded = stats.withColumn("_code", pattern())
    total = {r[0]: r[1] for r in coded.groupBy("_code").agg(F.count("*")).collect()}
    codes = np.array(sorted(total), np.int64)
    known = np.zeros((len(codes), len(TYPES)))
    if labels is not None:
        # Labels grow with the documents: neither side is broadcast.
        rows = coded.select("doc_id", "_code").join(labels.select("doc_id", "text_class").hint("merge"), "doc_id").groupBy("_code", "text_class").agg(F.count("*")).collect()
        for code, name, n in rows:
            if name in TYPES:
                known[np.searchsorted(codes, code), TYPES.index(name)] += n
    post, _ = learned(codes, np.array([total[c] for c in codes], float), known)
    rows = [(int(c), *map(float, p)) for c, p in zip(codes, post)]
    learnt = stats.sparkSession.createDataFrame(rows, "_code int, " + ", ".join(f"p_{t} double" for t in TYPES))
    most = F.greatest(*[f"p_{t}" for t in TYPES])
    best = F.coalesce(*[F.when(F.col(f"p_{t}") == most, F.lit(t)) for t in TYPES])
    out = coded.join(F.broadcast(learnt), "_code").drop("_code")  # at most PATTERNS rows
    wordless = (F.col("n_words") == 0) | (F.col("symbol_ratio") >= 1)
    out = out.withColumn("text_type", F.when(wordless, "junk").otherwise(best))
    return out.withColumn("is_prose", ~wordless & (F.col("p_prose") >= 0.5))


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = staged(statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words")), "statistics")
    return typed(stats, table(spark, sf_dir, "doc_labels"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir).filter(~F.col("is_prose")).select("doc_id")


def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its statistics, the posterior of each text type and the likeliest type."""
    return _typed(spark, sf_dir)


PLAIN_ONES = ("n_words", "n_lines", "n_chars", "mean_word_length", "symbol_ratio", "digit_ratio", "punctuated_lines", "common_words")


def plain_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the statistics that count words, characters and lines only."""
    stats = statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))
    return stats.select("doc_id", *[F.round(c, 6).alias(c) if STATISTICS[c] == "double" else F.col(c) for c in PLAIN_ONES])


_BLANK = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_EDGE = EDGE.replace("'", "''")
QUERIES = {"p8_found": found, "p8_statistics": text_statistics, "p8_plain": plain_statistics}
SQL = {
    "p8_plain": rf"""
WITH c AS (SELECT list(DISTINCT lower(word)) AS common FROM common_words WHERE word IS NOT NULL),
d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^{_BLANK}]+') AS token,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{_BLANK}]')) AS line FROM documents),
n AS (SELECT *, len(token) AS n_words, len(line) AS n_lines, length(regexp_replace(text, '[{_BLANK}]', '', 'g')) AS n_chars,
  length(regexp_replace(text, '[^\p{{L}}\p{{No}}\p{{Nl}}]', '', 'g')) AS letters, length(regexp_replace(text, '\P{{Nd}}', '', 'g')) AS digits,
  len(list_filter(line, lambda x: regexp_matches(x, '[.!?:;…"”»)][{_BLANK}]*$'))) AS ended, len(list_filter(token, lambda x: list_contains(common, trim(lower(x), '{_EDGE}')))) AS hits FROM d, c)
SELECT doc_id, n_words, n_lines, n_chars, coalesce(round(n_chars / nullif(n_words, 0), 6), 0) AS mean_word_length, coalesce(round(1 - (letters + digits) / nullif(n_chars, 0), 6), 0) AS symbol_ratio,
  coalesce(round(digits / nullif(n_chars, 0), 6), 0) AS digit_ratio, coalesce(round(ended / nullif(n_lines, 0), 6), 0) AS punctuated_lines, coalesce(round(hits / nullif(n_words, 0), 6), 0) AS common_words FROM n""",
}
