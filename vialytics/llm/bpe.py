"""Byte-level BPE encoding and decoding.

A word's symbols form a doubly linked list; a priority queue holds the ranks of mergeable neighbours and entries
whose symbols have changed since are skipped as stale. Decoding concatenates vocabulary strings.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .common import arrow_rows, batches

#: The white space that the tokenizers library's \s matches, and the byte-level pre-tokenizer's pattern.
WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
#: Coarser spans that no pre-token crosses; they are what the cache holds.
SPANS = re.compile(rf" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
CACHE_ENTRIES, CACHE_CHARS = 600_000, 48


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: printable Latin-1 as it is, the rest from U+0100 up."""
    plain = set(range(0x21, 0x7F)) | set(range(0xA1, 0xAD)) | set(range(0xAE, 0x100))
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class ByteBPE:
    """Encoder and decoder of one tokenizer file (its JSON text)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        self.byte_ids = [vocab[c] for c in letters]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_added = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        self.strings = {str(i): bytes(of_letter[c] for c in s) for s, i in vocab.items()}
        self.strings.update({str(i): t.encode() for t, i in self.added.items()})
        self.cache = _Cache(self)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token."""
        sym = [self.byte_ids[b] for b in word]
        n = len(sym)
        if n < 2:
            return sym
        merges = self.merges
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            if m := merges.get((sym[i], sym[i + 1])):
                queue.append((m[0], i, sym[i], sym[i + 1], m[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = nxt[i]
            if sym[i] != left or j >= n or sym[j] != right:
                continue  # stale: a neighbour was merged since
            sym[i], sym[j] = new, -1
            after, before = nxt[j], prv[i]
            nxt[i] = after
            if after < n:
                prv[after] = i
                if m := merges.get((new, sym[after])):
                    heapq.heappush(queue, (m[0], i, new, sym[after], m[1]))
            if before >= 0 and (m := merges.get((sym[before], new))):
                heapq.heappush(queue, (m[0], before, sym[before], new, m[1]))
        return [s for s in sym if s >= 0]

    def span_ids(self, span: str) -> str:
        body = span[1:] if span[0] == " " else span
        words = (span,) if body.isalpha() else PIECES.findall(span)
        return ",".join([str(i) for w in words for i in self.merge(w.encode())])

    def encode(self, text: str) -> str:
        """Decimal ids joined by commas."""
        cache = self.cache
        if not any(t in text for t in self.added):
            return ",".join([cache[s] for s in SPANS.findall(text)])
        out, at = [], 0
        for m in self.split_added.finditer(text):
            out += [cache[s] for s in SPANS.findall(text[at : m.start()])]
            out.append(str(self.added[m[0]]))
            at = m.end()
        return ",".join(out + [cache[s] for s in SPANS.findall(text[at:])])

    def decode(self, ids: str) -> str:
        if not ids:
            return ""
        strings = self.strings
        return b"".join([strings[i] for i in ids.split(",")]).decode(errors="replace")


class _Cache(dict):
    """Ids of spans; emptied when full, long spans are never held."""

    def __init__(self, bpe: ByteBPE):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, span: str) -> str:
        ids = self.bpe.span_ids(span)
        if len(span) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[span] = ids
        return ids


_LOADED: dict[str, ByteBPE] = {}


def loaded(source: Broadcast) -> ByteBPE:
    """One tokenizer for each Python worker."""
    key = hashlib.md5(source.value.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBPE(source.value)
    return _LOADED[key]


def read_tokenizer(df: DataFrame, path: str) -> Broadcast:
    """The tokenizer file is read on the driver and sent to the tasks (a few MB, whatever the input)."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for each row. Null text is empty text and has no ids; rows repeat as they do in docs."""
    source = read_tokenizer(docs, tokenizer_path)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(it):
        bpe = loaded(source)
        for ids, texts in batches(it, "doc_id", "text"):
            for lo in range(0, len(texts), 256):
                part = texts.slice(lo, 256).to_pylist()
                coded = [[int(i) for i in c.split(",")] if (c := bpe.encode(t or "")) else [] for t in part]
                yield arrow_rows(schema, doc_id=ids.slice(lo, 256), ids=coded)

    return docs.selectExpr("cast(doc_id as long) as doc_id", f"cast(`{text}` as string) as text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give empty text, ids outside the vocabulary fail."""
    source = read_tokenizer(encoded, tokenizer_path)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(it):
        bpe = loaded(source)
        for ids, coded in batches(it, "doc_id", "ids"):
            yield arrow_rows(schema, doc_id=ids, text=[bpe.decode(",".join(map(str, c or []))) for c in coded.to_pylist()])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, its ids decoded again, both as digests."""
    source = read_tokenizer(docs, tokenizer_path)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(it):
        bpe = loaded(source)
        for ids, texts in batches(it, "doc_id", "text"):
            out = []
            for t in texts:
                coded = bpe.encode(t.as_py() or "")
                text = bpe.decode(coded)
                out.append((coded.count(",") + 1 if coded else 0, hashlib.sha256(coded.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
            n, a, b = zip(*out)
            yield arrow_rows(schema, doc_id=ids, n_tokens=n, ids_sha256=a, decoded_sha256=b)

    cols = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return cols.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
