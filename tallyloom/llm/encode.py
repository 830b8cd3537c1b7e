"""Problem 7: the token ids of every text, by content-defined chunk reuse.

A rolling hash over the characters cuts each text into chunks whose borders depend only on the characters around them,
so a passage that several documents share is cut alike in all of them. Every task keeps a dictionary of the chunks it
has met: a chunk is encoded once, whichever documents hold it. A cut can fall inside a token, so no chunk's ids are
taken as they are. The tokenizer's pattern always ends a piece between a character that is not white space and one that
is, and what follows such a place is encoded independently of what stands before it. Of each chunk only the ids between
its first and its last such place are kept; the rest before and after is joined with the neighbours' rest and that join
is encoded again (its result is reused too). A chunk without such a place becomes part of the join altogether, which then
grows into the next chunk, until both sides agree. The ids are therefore exactly those of the whole text.

The dictionary is bounded (it is emptied when it holds too many characters, which costs time only), lives in the task
and is never shuffled: moving texts and ids between executors costs more than encoding a chunk again in another task.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public tokenizers lie; a parameter, the files are never copied.
TOKENIZERS = "/opt/tokenizers"
NAME = "byte_bpe_50k"
#: Mean distance of the cuts in characters: a power of two. The window has so many characters.
MEAN_CHUNK, WINDOW = 32, 8
#: Bytes, about, that a task's dictionary of chunks may hold.
MOST_HELD = 200_000_000
#: Bytes of text that are encoded in one step.
STEP = 4_000_000
#: The tokenizer's published splitting pattern (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(folder: str, name: str):
    """The tokenizer of a vocabulary file, once per Python worker."""
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def cuts(text: str, mean: int = MEAN_CHUNK) -> np.ndarray:
    """Chunk borders within the text: where a rolling hash of the last WINDOW characters is 0 modulo `mean`."""
    if len(text) <= WINDOW:
        return np.empty(0, np.int64)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    # hash of a window = sum of char * B^(place in it), modulo 2^32: doubled by prefix steps of 1, 2 and 4 characters
    h, step, b = c * np.uint32(2654435761), 1, 0x01000193
    while step < WINDOW:
        h = h[:-step] * np.uint32(b) + h[step:]
        step, b = step * 2, b * b & 0xFFFFFFFF
    h ^= h >> np.uint32(15)
    return np.flatnonzero((h & np.uint32(mean - 1)) == 0) + WINDOW


class ChunkEncoder:
    """Encodes lists of texts, reusing chunks; one per task."""

    def __init__(self, enc, mean: int = MEAN_CHUNK, most: int = MOST_HELD):
        self.encode, self.mean, self.most = enc.encode_ordinary, mean, most
        #: bytes of each token, to part the ids of several strings that were encoded in one call
        self.width = np.zeros(enc.n_vocab, np.int64)
        for i in range(enc.n_vocab):
            try:
                self.width[i] = len(enc.decode_single_token_bytes(i))
            except KeyError:
                pass
        self.clear()

    def clear(self) -> None:
        self.held = 0
        self.chunks: dict[str, tuple] = {}
        self.joins: dict[str, int] = {}
        # entry k of the store has the ids store[start[k]:start[k + 1]]; entry 0 has none
        self.store, self.start = array("i"), array("q", [0, 0])

    def enter(self, strings: list[str]) -> list[int]:
        """Encodes the strings in as few calls as possible; returns their entries in the store.

        Strings that begin with a blank and end with no white space can follow each other in one call: the places
        between them are safe. All others are encoded one by one.
        """
        first = len(self.start) - 1
        sizes = np.zeros(len(strings), np.int64)
        together, alone = [], []
        for i, s in enumerate(strings):
            (together if s[0] == " " and not s[-1].isspace() else alone).append(i)
        # ids come in the order: all that were encoded together, then the others; `place` leads back to the strings
        group = [strings[i] for i in together]
        ids = np.array(self.encode("".join(group)), np.int32)
        ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(x.encode()) for x in group], dtype=np.int64)) + 1 if group else np.empty(0, np.int64)
        sizes[together] = np.diff(ends, prepend=0)
        self.store.frombytes(ids.tobytes())
        for i in alone:
            got = self.encode(strings[i])
            self.store.extend(got)
            sizes[i] = len(got)
        order = np.array([*together, *alone], np.int64)
        self.start.extend((self.start[-1] + np.cumsum(sizes[order])).tolist())
        self.held += 2 * sum(map(len, strings)) + 100 * len(strings)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(first, first + len(order))
        return place.tolist()

    def learn(self, new: list[str]) -> None:
        """Each new chunk as (rest before the first safe place, entry of the ids between, rest after the last), or
        (chunk, 0, None) without a safe place.

        Safe is a place before a blank and after a character that is no white space: there a piece of the pattern ends
        always. (Places before other white space would be safe too and aren't needed.)
        """
        mids, parts = [], []
        for s in new:
            a = s.find(" ", 1)
            while a > 0 and s[a - 1].isspace():
                a = s.find(" ", a + 1)
            if a < 1:
                parts.append((s, s, None))
                self.held += len(s) + 100
                continue
            z = s.rfind(" ")
            while s[z - 1].isspace():
                z = s.rfind(" ", 0, z)
            parts.append((s, s[:a], s[z:]))
            if z > a:
                mids.append((len(parts) - 1, s[a:z]))
        entry = dict(zip((i for i, _ in mids), self.enter([m for _, m in mids])))
        for i, (s, head, tail) in enumerate(parts):
            self.chunks[s] = (head, entry.get(i, 0), tail)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts one after the other, where each text's begin and the last one's end)."""
        if self.held > self.most:
            self.clear()
        cut, pieces = [], set()
        for t in texts:
            c = ()
            if t:
                z = cuts(t, self.mean).tolist()
                c = [t[a:b] for a, b in zip([0, *z], [*z, len(t)])]
                pieces.update(c)
            cut.append(c)
        pieces.discard("")
        self.learn(list(pieces.difference(self.chunks)))
        js: list[str] = []
        ks: list[int] = []
        sizes = []
        get = self.chunks.__getitem__
        for c in cut:
            rest = ""
            for head, k, tail in map(get, filter(None, c)):
                # the place between two chunks always lies inside a join, which sees both sides of it
                if tail is None:
                    rest += head
                else:
                    js.append(rest + head)
                    ks.append(k)
                    rest = tail
            if rest:
                js.append(rest)
                ks.append(0)
            sizes.append(2 * len(js))
        new = list(set(js).difference(self.joins))
        self.joins.update(zip(new, self.enter(new)))
        at = np.empty(2 * len(js), np.int64)
        at[::2] = np.fromiter(map(self.joins.__getitem__, js), np.int64, len(js))
        at[1::2] = ks
        start = np.frombuffer(self.start, np.int64)
        begin, n = start[at], start[at + 1] - start[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        take = np.arange(ends[-1]) + np.repeat(begin - ends[:-1], n)
        flat = np.frombuffer(self.store, np.int32)[take] if len(take) else np.empty(0, np.int32)
        del start  # the arrays can't grow while a view of them lives
        return flat, ends[np.array([0, *sizes])]


def encode_corpus(df: DataFrame, text: str = "text", out: str = "ids", folder: str = TOKENIZERS, name: str = NAME, lengths_only: bool = False) -> DataFrame:
    """df with the column `out`: the ids (array of int) of the column `text`, or their number (int).

    A null and an empty text have no ids: an empty list, or 0. Special tokens are ordinary text. Texts of any length are
    encoded whole. A column `out` that df already has is replaced. Other columns pass through; rows keep their number.
    """
    rest = [c for c in df.columns if c != out]
    df = df.select(*[F.col(f"`{c}`") for c in rest])
    carried = [c for c in rest if c != text]
    kind = "int" if lengths_only else "array<int>"
    # only the text crosses to Python with what must travel beside it
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[F.col(f"`{c}`") for c in carried]).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = ChunkEncoder(encoding(folder, name))
        for b in batches:
            col = b.column(b.schema.get_field_index(text))
            at = 0
            while at < len(col):
                # so many rows at a time that a step holds about STEP characters
                far = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col.slice(at)), 0)))
                n = max(1, int(np.searchsorted(far, STEP)))
                part = b.slice(at, n)
                at += n
                flat, ends = enc(part.column(b.schema.get_field_index(text)).to_pylist())
                made = pa.array(np.diff(ends).astype(np.int32)) if lengths_only else pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(b.schema.get_field_index(c)) for c in carried] + [made], names=[*carried, out])

    return df.select(*[F.col(f"`{c}`") for c in [*carried, text]]).mapInArrow(run, (fields + ", " if fields else "") + f"`{out}` {kind}")
