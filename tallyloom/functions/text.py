"""Script-neutral text: Devanagari to Latin letters, phonetic folding, consonant skeletons, name parts, place keys.

Every function exists twice: as a Column expression that stays inside the JVM, and as a plain Python function for code
that already runs over Arrow batches. Tests hold the two against each other.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: the folding rules and word lists that results depend on -----------------------------------------
#: Replacements, applied one after the other in this order.
FOLDS = [
    ("ksh", "x"), ("chh", "c"), ("ch", "c"), ("sh", "s"), ("ph", "f"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("kh", "k"), ("gh", "g"), ("jh", "j"), ("w", "v"), ("v", "b"), ("z", "j"),
    ("q", "k"), ("x", "ks"), ("aa", "a"), ("ee", "i"), ("ii", "i"), ("oo", "u"), ("uu", "u"), ("ou", "o"), ("au", "o"), ("ai", "e"), ("y", "i"),
]
#: Consonants after which a stray h is dropped.
STRAY_H_AFTER = "bcdfgjklmnpqrstvx"
#: Words that carry no identity.
STOP = "devi debi kumari kaur kour smt shri sri late swargiya mr mrs ms km dr sv sw w/o s/o d/o"
#: Name prefixes with one canonical form, md.
PREFIX = "mohd md mo mohammad mohammed muhammad mohamad mohmmad mohamed"
#: Middle names that registers write or omit.
MIDDLE = "singh sinh chandra chandr chander chand chandro datt dutt dat ram lal prasad nath rani bala"
# --------------------------------------------------------------------------------------------------------------------

_PAIRS = FOLDS

# Devanagari by its Unicode order: five rows of stops with their aspirates and nasals, then the rest of the consonants
_PLAIN = {**dict(zip("कगङचजञटडणतदनपबम", "kgncjntdntdnpbm")), **dict(zip("यरलळवशषसह", "yrllvsssh")), "ऩ": "n", "ऱ": "r", "ऴ": "l"}
_BREATHY = dict(zip("खघछझठढथधफभ", "kgcjtdtdpb"))
_VOWEL = dict(zip("अआइईउऊऋएओऍऑऎऒ", "aaiiuureoeoeo"))
_SIGN = dict(zip("ािीुूृेोॅॉॆॊॄ", "aiiuureoeoeor"))
_TWO = {"ऐ": "ai", "औ": "au", "ै": "ai", "ौ": "au"}
_DIGIT = dict(zip("०१२३४५६७८९", "0123456789"))
#: Letters with a built-in dot, and what they are without it.
_DOTTED = {chr(0x958 + i): x for i, x in enumerate("कखगजडढफय")}
_ALL = "".join(_PLAIN) + "".join(_BREATHY)
_MARK = "\u0001"


def has_devanagari(c: Column) -> Column:
    return c.rlike("[\\u0900-\\u097F]")


def script(c: Column) -> Column:
    """'dev' where a Devanagari character occurs, else 'rom'."""
    return F.when(has_devanagari(c), F.lit("dev")).otherwise(F.lit("rom"))


def to_roman(c: Column) -> Column:
    """Lower-case Latin letters of a text in either script; null gives ''. Anusvara and chandrabindu read as n, a consonant
    without vowel sign or virama has the vowel a, dots below are dropped."""
    x = F.translate(c, "".join(_DOTTED), "".join(_DOTTED.values()))
    x = F.replace(x, F.lit("\u093c"), F.lit(""))
    x = F.regexp_replace(x, "[ँं]", "न्")
    x = F.regexp_replace(x, f"([{''.join(_BREATHY)}])", f"$1{_MARK}")
    x = F.regexp_replace(x, f"([{_ALL}]{_MARK}?)(?![ा-्ॢॣ{_MARK}])", "$1a")
    x = reduce(lambda y, p: F.replace(y, F.lit(p[0]), F.lit(p[1])), _TWO.items(), x)
    one = {**_PLAIN, **_BREATHY, **_VOWEL, **_SIGN, **_DIGIT, _MARK: "h", "ः": "h"}
    x = F.translate(x, "".join(one) + "्", "".join(one.values()))
    return F.coalesce(F.lower(F.when(has_devanagari(c), x).otherwise(c)), F.lit(""))


def fold_word(c: Column) -> Column:
    """The phonetic folding of one word of Latin letters."""
    x = reduce(lambda y, p: F.replace(y, F.lit(p[0]), F.lit(p[1])), _PAIRS, F.regexp_replace(c, "[^a-z]", ""))
    x = F.regexp_replace(x, "(.)\\1+", "$1")
    x = F.regexp_replace(x, f"(?<=[{STRAY_H_AFTER}])h", "")
    return F.when(F.length(x) > 3, F.regexp_replace(x, "a$", "")).otherwise(x)


def skeleton(c: Column) -> Column:
    """The first letter and the consonants after it."""
    return F.concat(F.substring(c, 1, 1), F.regexp_replace(F.substring(c, 2, 10_000), "[aeiou]", ""))


# ---- the same in Python ----


def roman_text(s: str | None) -> str:
    if not s:
        return ""
    if s.isascii() or not any("ऀ" <= x <= "ॿ" for x in s):
        return s.lower()
    s = unicodedata.normalize("NFC", s)
    out = []
    for i, x in enumerate(s):
        if x == "\u093c":
            continue
        x = _DOTTED.get(x, x)
        if x in _PLAIN or x in _BREATHY:
            out.append(_PLAIN.get(x) or _BREATHY[x] + "h")
            j = i + 1
            while j < len(s) and s[j] == "\u093c":
                j += 1
            nxt = s[j] if j < len(s) else ""
            if not ("ा" <= nxt <= "्" or nxt in "ॢॣ") or nxt == "":
                out.append("a")
        elif x in "ँं":
            out.append("n")
        else:
            out.append(_TWO.get(x) or _VOWEL.get(x) or _SIGN.get(x) or _DIGIT.get(x) or ("h" if x == "ः" else "" if x == "्" else x))
    return "".join(out).lower()


_NOT_AZ, _TWICE, _H = re.compile("[^a-z]"), re.compile(r"(.)\1+"), re.compile(f"(?<=[{STRAY_H_AFTER}])h")


@lru_cache(maxsize=200_000)
def folded(w: str) -> str:
    w = _NOT_AZ.sub("", w)
    for a, b in _PAIRS:
        if a in w:
            w = w.replace(a, b)
    w = _H.sub("", _TWICE.sub(r"\1", w))
    return w[:-1] if len(w) > 3 and w.endswith("a") else w


def skeleton_of(w: str) -> str:
    return w[:1] + re.sub("[aeiou]", "", w[1:])


STOP_FOLDED = frozenset(folded(w) for w in STOP.split())
PREFIX_FOLDED = frozenset(folded(w) for w in PREFIX.split())
MIDDLE_FOLDED = frozenset(folded(w) for w in MIDDLE.split())


def split_name(c: Column) -> Column:
    """struct(first, middle, last, fold, skel_first, skel_last) of a name in either script; '' where a part is absent.

    Honorifics are dropped, a prefix of the md family before another word becomes the middle part 'md', the first word is
    the given name, known middle names go to middle, the last other word is the surname.
    """
    in_ = lambda w, s: w.isin(*sorted(s))
    words = F.filter(F.transform(F.split(to_roman(c), "[\\s.\\-,/]+"), fold_word), lambda w: (w != "") & ~in_(w, STOP_FOLDED))

    def leading(ws: Column) -> Column:
        """How many prefixes fall away, as long as another word is left."""
        step = lambda s, w: F.when((s >= 0) & in_(w, PREFIX_FOLDED), s + 1).when(s >= 0, -s - 1).otherwise(s)
        n = F.aggregate(ws, F.lit(0), step, lambda s: F.when(s < 0, -s - 1).otherwise(s))
        return F.least(n, F.greatest(F.size(ws) - 1, F.lit(0)))

    def rest_of(x: Column) -> Column:
        rest = F.slice(x.ws, x.drop + 2, F.greatest(F.size(x.ws), F.lit(1)))
        return F.struct(
            F.coalesce(F.get(x.ws, x.drop), F.lit("")).alias("first"), (x.drop > 0).alias("md"),
            F.filter(rest, lambda w: in_(w, MIDDLE_FOLDED)).alias("mid"), F.filter(rest, lambda w: ~in_(w, MIDDLE_FOLDED)).alias("core"),
        )

    def parts(x: Column) -> Column:
        last = F.coalesce(F.try_element_at(x.core, F.lit(-1)), F.lit(""))
        return F.struct(
            x["first"].alias("first"), F.array_join(F.concat(F.when(x.md, F.array(F.lit("md"))).otherwise(F.array().cast("array<string>")), x.mid), " ").alias("middle"),
            last.alias("last"), F.trim(F.concat_ws(" ", F.concat(F.array(x["first"]), x.core))).alias("fold"), skeleton(x["first"]).alias("skel_first"), skeleton(last).alias("skel_last"),
        )

    return _let(words, lambda ws: _let(F.struct(ws.alias("ws"), leading(ws).alias("drop")), lambda x: _let(rest_of(x), parts)))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def place_key(c: Column) -> Column:
    """One key for the spellings of a place: the word 'ward', digits and blanks removed, folded, digits appended as w<digits>."""
    r = to_roman(c)
    digits = F.array_join(F.regexp_extract_all(r, F.lit("(\\d+)"), 1), "")
    return F.concat(fold_word(F.regexp_replace(r, "\\bward\\b|\\d+|\\s", "")), F.when(digits != "", F.concat(F.lit("w"), digits)).otherwise(""))


def titled(c: Column) -> Column:
    """Every run of Latin letters with a capital first letter and small ones after it."""
    parts = F.regexp_extract_all(F.lower(c), F.lit("([a-z]+|[^a-z]+)"), 1)
    return F.when(c.isNotNull(), F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), ""))


# ---- string distance ----


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity: prefix scale 0.1 over at most 4 letters, boosted above a Jaro similarity of 0.7."""
    if a == b:
        return 1.0 if a else 0.0
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    reach = max(0, max(la, lb) // 2 - 1)
    used, ma = [False] * lb, []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(lb, i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                ma.append(x)
                break
    m = len(ma)
    if not m:
        return 0.0
    mb = [y for j, y in enumerate(b) if used[j]]
    half = sum(x != y for x, y in zip(ma, mb)) // 2
    jaro = (m / la + m / lb + (m - half) / m) / 3
    if jaro <= 0.7:
        return jaro
    p = 0
    while p < min(4, la, lb) and a[p] == b[p]:
        p += 1
    return jaro + p * 0.1 * (1 - jaro)


def osa(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between a and b; most + 1 where they are more than `most`."""
    la, lb = len(a), len(b)
    if abs(la - lb) > most:
        return most + 1
    prev2: list[int] = []
    prev = list(range(lb + 1))
    for i in range(1, la + 1):
        cur = [i] + [most + 1] * lb
        lo, hi = max(1, i - most), min(lb, i + most)
        x = a[i - 1]
        for j in range(lo, hi + 1):
            y = b[j - 1]
            v = prev[j - 1] + (x != y)
            if prev[j] + 1 < v:
                v = prev[j] + 1
            if cur[j - 1] + 1 < v:
                v = cur[j - 1] + 1
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and prev2[j - 2] + 1 < v:
                v = prev2[j - 2] + 1
            cur[j] = v
        if min(cur) > most:
            return most + 1
        prev2, prev = prev, cur
    return min(prev[lb], most + 1)
