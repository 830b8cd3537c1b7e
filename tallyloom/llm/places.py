"""Problem 1: typed places mapped to a reference list, by token-level repair and soft TF-IDF.

Each distinct token of the typed values (and each run of tokens, as many as an entry has and three at least, for names written
apart) is joined to the vocabulary of the reference list, which are its names written together and, where names have several
words, their words, by edit distance: a symmetric-delete index of the vocabulary finds all words within the bound, on the
letters as typed and on their phonetic folding; a token that was cut short finds the words it begins. The repaired tokens
are then combined per value: an entry's score is the cosine of soft TF-IDF, where a repaired token counts with its
similarity and the weight of its rarity in the list, and tokens that repair to nothing count against the value by their rarity in
the typed corpus (words that clerks add anywhere, such as 'village' or 'ward', are frequent and cost nothing). The record's block ranks entries of
like score and decides between entries of one name. Values whose best entry scores too low mean no listed entry.

The reference list is fixed and small (its size is checked); tasks hold its index and remember the tokens and values they
have met, so rows are not shuffled for the search and a value that a third of the rows carry costs one lookup per row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import folded, osa, roman_text, to_roman

#: The reference list may have so many entries; above, mapping is refused rather than broadcast.
MOST_ENTRIES = 100_000
#: Tokens in at least this share of the typed values are words that can stand beside any place; what a stray token costs grows
#: with its rarity from there to RARE, below which it costs all.
COMMON, RARE = 0.003, 0.001
#: Least score of an entry; what the record's block adds or takes.
LEAST, SAME_BLOCK, OTHER_BLOCK = 0.6, 0.05, -0.12
#: Words a clerk writes for "no place given" repair to nothing anyway; these would be taken for short names (fixed values).
NOTHING = frozenset("na nil none unknown same above xxxx nahi nahin".split())
#: Words that keys have glued to a place although their letters are written apart (V.P.O. is village post office).
GLUED = ("vpo", "gp", "tokof", "nearschool", "grampanchayat")
_WORD = re.compile("[a-z]+")
_WARD = re.compile(r"\b(?:ward|vard|varda|w)\b[\s.\-]*(?:no\b|n\b|nan\b|number\b)?[\s.\-]*\d+")


def bound(n: int) -> int:
    """Edits that a word of n letters may have."""
    return 0 if n < 3 else 1 if n < 5 else 2 if n < 10 else 3


def _deletes(w: str, k: int) -> set[str]:
    out = {w}
    for i in range(1, min(k, len(w) - 1) + 1):
        out |= {"".join(x for j, x in enumerate(w) if j not in gone) for gone in combinations(range(len(w)), i)}
    return out


class Vocabulary:
    """Words with an index of their deletions; finds all words within the bound."""

    def __init__(self, words: set[str]):
        self.words = sorted(words)
        self.index: dict[str, list[int]] = {}
        for i, w in enumerate(self.words):
            for d in _deletes(w, bound(len(w))):
                self.index.setdefault(d, []).append(i)

    def near(self, w: str) -> dict[str, int]:
        k = bound(len(w) + 1)
        hits = {i for d in _deletes(w, k) for i in self.index.get(d, ())}
        out = {}
        for i in hits:
            v = self.words[i]
            most = bound(max(len(w), len(v)))
            d = osa(w, v, most)
            if d <= most and d < len(w):
                out[v] = d
        return out

    def begun(self, w: str) -> list[str]:
        return [v for v in self.words if len(v) > len(w) and v.startswith(w)] if len(w) >= 4 else []


class PlaceMatcher:
    """Finds the entry of a typed value; one per task."""

    def __init__(self, entries: list[tuple[int, str, str, str]], shares: dict[str, float], counts: dict[str, int] | None = None):
        common = {w for w, s in shares.items() if s >= COMMON}
        self.shares = shares
        total = 1 + sum((counts or {}).values())
        #: of entries that score alike, the one that is written more often
        self.prior = {i: 0.05 * (counts or {}).get(name, 0) / total for i, name, _, _ in entries}
        self.by_raw: dict[str, list[int]] = {}
        self.by_key: dict[str, list[int]] = {}
        self.block: dict[int, str] = {}
        for i, name, key, block in entries:
            self.by_raw.setdefault("".join(_WORD.findall(roman_text(name))), []).append(i)
            self.by_key.setdefault(key, []).append(i)
            self.block[i] = block_key(block)
        self.raw, self.key = Vocabulary({w for w in self.by_raw if w}), Vocabulary({w for w in self.by_key if w})
        self.blocks = {b for b in self.block.values() if b}
        self.ends = sorted(self.blocks)
        self.weight = math.log(1 + len(entries))
        # names of several words, word by word
        self.parts = {i: ws for i, name, _, _ in entries if len(ws := set(_WORD.findall(roman_text(name)))) > 1}
        self.longest = max([3, *(len(_WORD.findall(roman_text(name))) for _, name, _, _ in entries)])
        self.of_part: dict[str, list[int]] = {}
        for i, ws in self.parts.items():
            for w in ws:
                self.of_part.setdefault(w, []).append(i)
        self.part = Vocabulary(set(self.of_part))
        self.idf = {w: math.log(1 + len(entries) / len(ids)) for w, ids in self.of_part.items()}
        # a common spelling of an entry is no word that stands beside any place
        self.common = {w for w in common if max(self.repair(w).values(), default=0.0) < 0.75}
        self.glued = sorted({g for w in [*self.common, "block", *GLUED] if len(w) > 1 for g in (folded(w), folded(w) + "a") if len(g) > 1} - {"a"}, key=lambda g: (-len(g), g))
        self.tokens: dict = {}
        self.values: dict = {}

    def repair(self, gram: str) -> dict[int, float]:
        """Entries by the similarity of their name to the gram, typed or folded."""
        out: dict[int, float] = {}

        def put(ids: list[int], sim: float) -> None:
            for i in ids:
                out[i] = max(sim, out.get(i, 0.0))

        for v, d in self.raw.near(gram).items():
            put(self.by_raw[v], 1 - d / max(len(gram), len(v)))
        key = folded(gram)
        for i, sim in self.repair_key(key).items():
            put([i], sim - 0.01)
        return out

    def repair_key(self, key: str) -> dict[int, float]:
        out: dict[int, float] = {}
        for v, d in self.key.near(key).items():
            for i in self.by_key[v]:
                out[i] = max(1 - d / max(len(key), len(v)), out.get(i, 0.0))
        for v in self.key.begun(key):
            for i in self.by_key[v]:
                out[i] = max(0.7 + 0.2 * len(key) / len(v), out.get(i, 0.0))
        return out

    def of_gram(self, gram: str) -> dict[int, float]:
        r = self.tokens.get(gram)
        if r is None:
            if len(self.tokens) > 300_000:
                self.tokens.clear()
            r = self.tokens[gram] = {} if gram in NOTHING else self.repair(gram)
        return r

    def scores(self, value: str) -> tuple[dict[int, float], set[str]]:
        """(entries by soft TF-IDF, blocks named in the value)."""
        text = _WARD.sub(" ", roman_text(value))
        words = _WORD.findall(text)
        named = {folded(w) for w in words} & self.blocks
        costs = []
        for w in words:
            f = folded(w)
            # 0 for a common token, growing with its inverse document frequency
            rare = math.log(COMMON / max(self.shares.get(w, 0.0), RARE)) / math.log(COMMON / RARE)
            costs.append(0.0 if w in self.common or f in self.blocks or len(w) < 3 else 0.75 * self.weight * min(1.0, max(0.0, rare)))
        total = sum(c * c for c in costs)
        out: dict[int, float] = {}
        for i, s in self.word_by_word(words, costs).items():
            out[i] = s
        for n in range(1, min(self.longest, len(words)) + 1):
            for a in range(len(words) - n + 1):
                gram = "".join(words[a : a + n])
                if n > 1 and all(w in self.common for w in words[a : a + n]):
                    continue
                hits = self.of_gram(gram)
                if not hits:
                    continue
                rest = max(0.0, total - sum(c * c for c in costs[a : a + n]))
                part = self.weight / math.sqrt(self.weight**2 + rest)
                # a block's name alone is no place unless nothing else is written
                only = folded(gram) in self.blocks and len(words) > n
                for i, sim in hits.items():
                    s = sim * part - (0.02 if only else 0.0)
                    if s > out.get(i, 0.0):
                        out[i] = s
        return out, named

    def word_by_word(self, words: list[str], costs: list[float]) -> dict[int, float]:
        """Entries of several words by the cosine of soft TF-IDF over repaired words, in any order."""
        if not self.parts:
            return {}
        got: dict[int, dict[str, tuple[float, int]]] = {}
        for k, w in enumerate(words):
            for v, d in self.part.near(w).items():
                sim = 1 - d / max(len(w), len(v))
                for i in self.of_part[v]:
                    if sim > got.setdefault(i, {}).get(v, (0.0, 0))[0]:
                        got[i][v] = (sim, k)
        total = sum(c * c for c in costs)
        out = {}
        for i, hits in got.items():
            square = sum(self.idf[v] ** 2 for v in hits)
            rest = max(0.0, total - sum(costs[k] ** 2 for k in {k for _, k in hits.values()}))
            norm = math.sqrt(sum(self.idf[v] ** 2 for v in self.parts[i])) * math.sqrt(square + rest)
            out[i] = sum(self.idf[v] ** 2 * sim for v, (sim, _) in hits.items()) / norm
        return out

    def key_scores(self, key: str) -> tuple[dict[int, float], set[str]]:
        """The same for a folded key without blanks: words glued to the place are taken off at either end."""
        key = re.sub(r"(?:bard|ward|w)?w?\d+$", "", key)
        # what is left after words were taken off is a piece of the key: all such pieces, told by where they begin and end
        named, out = set(), {}
        seen, todo = {(0, len(key))}, [(0, len(key))]
        while todo:
            a, b = todo.pop()
            cut = [(a + len(g), b) for g in self.glued if key.startswith(g, a, b)] + [(a, b - len(g)) for g in self.glued if key.endswith(g, a, b)]
            cut += [(a, b - len(x)) for x in self.ends if key.endswith(x, a, b)] + [(a, b - len(x) + 1) for x in self.ends if x[0] == "h" and key.endswith(x[1:], a, b)]
            for x in cut:
                if x[1] - x[0] >= 3 and x not in seen:
                    seen.add(x)
                    todo.append(x)
        for k in {key[a:b] for a, b in seen}:
            r = self.tokens.get((k,))
            if r is None:
                r = self.tokens[(k,)] = {} if k in NOTHING else self.repair_key(k)
            for i, sim in r.items():
                s = sim if k == key else sim - 0.01
                if s > out.get(i, 0.0):
                    out[i] = s
        return out, named

    def __call__(self, value: str, block: str | None, is_key: bool) -> int:
        b = block_key(block)
        at = (value, b, is_key)
        got = self.values.get(at)
        if got is None:
            if len(self.values) > 300_000:
                self.values.clear()
            got = self.values[at] = self.best(value, b, is_key)
        return got

    def best(self, value: str, b: str, is_key: bool) -> int:
        scores, named = self.key_scores(value) if is_key else self.scores(value)
        where = {b} & self.blocks or named
        ranked = []
        for i, s in scores.items():
            if where:
                s += SAME_BLOCK if self.block[i] in where else OTHER_BLOCK
            ranked.append((-s - self.prior[i], i))
        ranked.sort()
        return ranked[0][1] if ranked and -ranked[0][0] >= LEAST else -1


def block_key(block: str | None) -> str:
    return folded("".join(_WORD.findall(roman_text(block)))) if block else ""


def token_shares(values: DataFrame, least: float = RARE) -> dict[str, float]:
    """Tokens in at least `least` of the rows of `values` (column value) with their share: fewer than (tokens of a value) / least."""
    t = values.select(F.explode(F.array_distinct(F.split(to_roman(F.col("value")), "[^a-z]+"))).alias("t"))
    n = values.count()
    return {r["t"]: r["count"] / n for r in t.filter("t <> ''").groupBy("t").count().filter(F.col("count") >= least * n).collect()}


def map_places(typed: DataFrame, units: DataFrame) -> DataFrame:
    """(src, record_id, unit_id): the entry of `units` that each row of `typed` (src, record_id, value, block, is_key)
    means, or -1.

    A null or blank value and one that equals an entry byte for byte (panchayat; panchayat_key for rows with is_key) is no
    case and gives no row. A record that is delivered again counts once (the smallest unit_id, should its values differ).
    A null or unknown block decides nothing; then of entries with one name and score the smallest unit_id is taken. An
    empty list maps everything to -1. Values are searched whole, however long. Extra columns are ignored.
    """
    spark = typed.sparkSession
    entries = [tuple(r) for r in units.select("unit_id", "panchayat", "panchayat_key", "block").limit(MOST_ENTRIES + 1).collect()]
    if len(entries) > MOST_ENTRIES:
        raise ValueError(f"the reference list has more than {MOST_ENTRIES} entries")
    entries = [e for e in entries if e[0] is not None and e[1] is not None]
    names, keys = sorted({e[1] for e in entries}), sorted({e[2] for e in entries if e[2]})
    exact = spark.createDataFrame([(n, False) for n in names] + [(k, True) for k in keys], "value string, is_key boolean")
    cases = typed.select("src", "record_id", "value", "block", "is_key").filter(F.col("value").rlike("[^\\s\\p{Z}]") & F.col("record_id").isNotNull())
    cases = cases.join(F.broadcast(exact), ["value", "is_key"], "left_anti")  # the list is bounded by MOST_ENTRIES
    shares = token_shares(cases.filter("NOT is_key"))
    # one row per entry at most
    exactly = typed.filter("NOT is_key").join(F.broadcast(exact.filter("NOT is_key").select("value")), "value").groupBy("value").count()
    held = spark.sparkContext.broadcast((entries, shares, {r["value"]: r["count"] for r in exactly.collect()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = PlaceMatcher(*held.value)
        for b in batches:
            got = [m(v, k, f) for v, k, f in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(got, pa.int32())], names=["src", "record_id", "unit_id"])

    cases = cases.select("src", "record_id", "value", "block", "is_key")
    return cases.mapInArrow(run, "src string, record_id string, unit_id int").groupBy("src", "record_id").agg(F.min("unit_id").alias("unit_id"))


def with_unit(df: DataFrame, value: str, block: str, units: DataFrame, out: str = "unit") -> DataFrame:
    """df with the unit_id that the typed place means, or null; exact names are looked up like all others. Rows keep their
    place: no shuffle. A column `out` that df has is replaced."""
    spark = df.sparkSession
    entries = [tuple(r) for r in units.select("unit_id", "panchayat", "panchayat_key", "block").limit(MOST_ENTRIES + 1).collect()]
    if len(entries) > MOST_ENTRIES:
        raise ValueError(f"the reference list has more than {MOST_ENTRIES} entries")
    entries = [e for e in entries if e[0] is not None and e[1] is not None]
    typed = df.select(F.col(value).alias("value")).filter(F.col("value").rlike("[^\\s\\p{Z}]"))
    names = spark.createDataFrame([(n,) for n in sorted({e[1] for e in entries})], "value string")
    held = spark.sparkContext.broadcast((entries, token_shares(typed.join(F.broadcast(names), "value", "left_anti"))))
    df = df.drop(out)
    cols = df.columns
    v, b = cols.index(value), cols.index(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = PlaceMatcher(*held.value)
        for x in batches:
            got = [m(p, k, False) if p else -1 for p, k in zip(x.column(v).to_pylist(), x.column(b).to_pylist())]
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array([g if g >= 0 else None for g in got], pa.int32())], names=[*cols, out])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` int")
