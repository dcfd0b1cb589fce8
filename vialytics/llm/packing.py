"""Packing token sequences: first-fit decreasing with a tournament tree of bin capacities.

Documents are tokenized and cut into pieces of at most one sequence; pieces are dealt at random into groups of
bounded size, and each group is packed on its own.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import read_tokenizer
from .common import CACHES, arrow_rows, batches, fresh, frugal, give_back, materialize

SEQUENCE = 4096
GROUP_PIECES = 4096
END_ID = 2
#: White space that separates words for certain; the tokenizer drops it. Closing punctuation behind an ASCII letter or
#: digit is a word of its own to the tokenizer, so a space before it changes nothing and lets words share cache entries.
CLOSING = re.compile(rb"(?<=[a-z0-9])(?=[.,!?;:]+(?:[ \t\n\r\x0b\x0c]|$))")
PLAIN = re.compile(rb"[a-z]+")
#: A worker's cache of words is emptied at this many bytes (keys and ids, and OVERHEAD for each entry) and by other operators.
CACHE_BYTES, OVERHEAD, CACHE_CHARS = 96 << 20, 150, 48


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item; a tournament tree holds the largest free space below each node.

    Items longer than capacity are refused; items of length 0 take no space.
    """
    n = len(lengths)
    if n and int(lengths.max()) > capacity:
        raise ValueError("an item is longer than a sequence")
    size = 1 << max(0, (n - 1)).bit_length()
    tree = [capacity] * (2 * size)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        node = 1
        while node < size:  # leftmost leaf with room
            node *= 2
            if tree[node] < need:
                node += 1
        bins[i], offsets[i] = node - size, capacity - tree[node]
        tree[node] -= need
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offsets


class WordTokenizer:
    """The library's tokenizer behind a bounded cache of words."""

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(source)
        self.tok.no_truncation()
        self.tok.no_padding()
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.added = {t.content: np.array([i], dtype="<u4").tobytes() for i, t in self.tok.get_added_tokens_decoder().items()}
        self.split_added = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        self.clear()

    def clear(self) -> None:
        self.cache, self.size = {}, 0

    def words(self, text: str) -> list[bytes]:
        """The words of a text, ASCII letters in lower case: the tokenizer lowers them anyway, and lowers all others itself.

        Added tokens are found in the text as it is, before anything is lowered; a space in front marks them.
        """
        if not any(t in text for t in self.added):
            return CLOSING.sub(b" ", text.encode().lower()).split()
        out, at = [], 0
        for m in self.split_added.finditer(text):
            out += CLOSING.sub(b" ", text[at : m.start()].encode().lower()).split()
            out.append(b" " + m[0].encode())
            at = m.end()
        return out + CLOSING.sub(b" ", text[at:].encode().lower()).split()

    def encoded(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.words(t) for t in texts]
        long = {}
        if missing := set().union(*split).difference(self.cache):
            new = _learn(self, missing)
            long = {w: v for w, v in new.items() if len(w) > CACHE_CHARS}
            kept = {w: v for w, v in new.items() if w not in long} if long else new
            self.cache.update(kept)
            self.size += sum(map(len, kept)) + sum(map(len, kept.values())) + OVERHEAD * len(kept)
        if long:
            get = self.cache.get
            out = [b"".join([v if (v := get(w)) is not None else long[w] for w in ws]) for ws in split]
        else:
            out = [b"".join(map(self.cache.__getitem__, ws)) for ws in split]
        if self.size >= CACHE_BYTES:
            self.clear()
        return out


_WORKER: dict[str, WordTokenizer] = {}


def _tokenizer(source: Broadcast) -> WordTokenizer:
    """One tokenizer for each Python worker."""
    key = hashlib.md5(source.value.encode()).hexdigest()
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = WordTokenizer(source.value)
        CACHES["words"] = _WORKER[key].clear
    return _WORKER[key]


def _learn(own: WordTokenizer, words: set[bytes]) -> dict[bytes, bytes]:
    """The ids of words not in the cache.

    Words of ASCII letters are one pre-token each, so many are encoded as one text and cut behind ids that end a word.
    Words that only lowering made look like an added token go to the tokenizer in upper case, which it lowers itself.
    """
    tok, ends = own.tok, own.ends
    plain, rest, new = [], [], {}
    for w in words:
        if PLAIN.fullmatch(w):
            plain.append(w)
        elif w[:1] == b" ":
            new[w] = own.added[w[1:].decode()]
        else:
            rest.append(w)
    sent = b" ".join(rest).decode().split(" ")[: len(rest)]
    if own.split_added.search(" ".join(sent)):
        sent = [x.encode().upper().decode() if own.split_added.search(x) else x for x in sent]
    new.update((w, np.array(e.ids, dtype="<u4").tobytes()) for w, e in zip(rest, tok.encode_batch_fast(sent, add_special_tokens=False)))
    if plain:
        ids = np.array(tok.encode_batch_fast([b" ".join(plain).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
        cut = (np.flatnonzero(ends[ids]) + 1).tolist()
        if len(cut) != len(plain):
            raise ValueError("a word of letters is not one pre-token of this tokenizer")
        raw = ids.tobytes()
        new.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(plain, [0, *cut], cut))
    return new


def pieces(docs: DataFrame, tokenizer_path: str, length: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): each row's ids and end_id, cut every `length` ids.

    Null text is empty text: one piece that holds end_id alone. Rows repeat as they do in docs.
    """
    source = read_tokenizer(docs, tokenizer_path)
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    schema = pa.schema(kinds + [("ids", pa.binary())] * with_ids)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(it):
        own = _tokenizer(source)
        for ids, texts in batches(it, "doc_id", "text"):
            for lo in range(0, len(texts), 64):
                out, part = [], texts.slice(lo, 64).to_pylist()
                for i, raw in zip(ids.slice(lo, 64).to_pylist(), own.encoded([t or "" for t in part])):
                    raw += end
                    for at in range(0, len(raw), 4 * length):
                        cut = raw[at : at + 4 * length]
                        out.append((i, at // 4, len(cut) // 4, zlib.crc32(cut), len(raw) // 4, cut)[: len(schema)])
                yield arrow_rows(schema, **dict(zip(schema.names, zip(*out))))

    cols = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return cols.mapInArrow(frugal(run, "words"), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)


def pack(items: DataFrame, length: int = SEQUENCE, group_size: int = GROUP_PIECES, seed: int = 7) -> DataFrame:
    """items (a table with a long column `length`) and for each row sequence_id and offset.

    Rows are dealt by their number, hashed, to ceil(rows / group_size) random groups, so that a group grows neither with
    the input nor with rows that repeat; sequence ids are unique, and offsets fill each sequence without gaps. Equal rows
    are packed each on its own, an empty table gives an empty result, and items may have columns of any other name.
    """
    number, group = fresh("_number", items.columns), fresh("_group", items.columns)
    cols = items.columns
    numbered = materialize(items.withColumn(number, F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-numbered.count() // group_size))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(dtype=np.int64), length)
        out = pdf[cols].assign(sequence_id=bins * groups + pdf[group], offset=offsets)
        give_back()
        return out

    dealt = numbered.withColumn(group, F.pmod(F.xxhash64(number, F.lit(seed)), F.lit(groups))).drop(number)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return dealt.groupBy(group).applyInPandas(run, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place: pieces() and pack() together."""
    return pack(pieces(docs, tokenizer_path, length, with_ids=with_ids), length)
