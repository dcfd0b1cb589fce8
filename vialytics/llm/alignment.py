"""Two tokenizers aligned by the bytes of their tokens.

Python only encodes: each text becomes the ids and the end offsets (in bytes) of its tokens under a byte-level BPE (A)
and a sentencepiece model (B). The rest are Spark's higher-order functions: `array_intersect` of the two lists of ends
finds the offsets where tokens of both end, which cut the tokens into groups; `transform` and `filter` list the tokens
and links of each group. How many documents hold a pair of ids is counted over all documents; the most frequent pairs,
whose number is bounded by a share of the total, are looked up by broadcast, all others by a shuffled join.

Texts that are null or empty, and texts that a tokenizer changes (its tokens' bytes joined are not the text with a space
in front), have no tokens: zeros and an empty digest. Special tokens' strings in a text are plain text. Rows repeat as they
do in the input, each counts as a document of its own; a null doc_id stays null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import PIECES, ByteBPE, read_tokenizer
from .common import CACHES, batches, frugal, materialize, sweep

#: At most so many pairs of ids are broadcast: those whose count is at least the sum of all counts divided by it.
FREQUENT = 100_000
#: Bits of B's id in a pair, as one long.
B_BITS = 24
#: Texts encoded at once, in characters.
SLICE = 1 << 20
_TOKENS = pa.schema([("doc_id", pa.int64())] + [(f"{t}_{c}", pa.list_(pa.int32())) for t in "ab" for c in ("ids", "lengths", "ends")])


class ByteLevel:
    """Tokenizer A from its JSON text. A merge's rank is its id, so the library for rank files gives the same ids; added tokens' strings are plain text."""

    def __init__(self, source: str):
        strings = ByteBPE(source).strings
        added = {str(t["id"]) for t in json.loads(source)["added_tokens"]}
        ranks = {s: int(i) for i, s in strings.items() if i not in added}
        self.library = tiktoken.Encoding("own", pat_str=PIECES.pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(1 + max(map(int, strings)), np.int32)
        self.lengths[[*ranks.values()]] = [len(s) for s in ranks]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.library.encode_ordinary(" " + t) for t in texts]

    def spelled(self, ids: list[int]) -> bytes:
        return self.library.decode_bytes(ids)


class Pieces:
    """Tokenizer B, a sentencepiece model that puts a space in front of what it encodes."""

    def __init__(self, model: bytes):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        self.bytes = [bytes([int(n[3:5], 16)]) if sp.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.lengths = np.array([len(x) for x in self.bytes], np.int32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)

    def spelled(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes[i] for i in ids])


_LOADED: dict[str, tuple[ByteLevel, Pieces]] = {}
CACHES["alignment"] = _LOADED.clear


def tokenize(docs: DataFrame, byte_bpe_path: str, piece_path: str) -> DataFrame:
    """(doc_id, a_ids, a_lengths, a_ends, b_ids, b_lengths, b_ends), a row for each of docs; arrays are empty where a text has no tokens."""
    a_source = read_tokenizer(docs, byte_bpe_path)
    with open(piece_path, "rb") as f:
        b_source = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(it):
        for ids, texts in batches(it, "doc_id", "text"):
            both = _loaded(a_source, b_source)
            lo = 0
            while lo < len(texts):
                part, size, hi = [], 0, lo
                while hi < len(texts) and (not part or size < SLICE):
                    part.append(texts[hi].as_py() or "")
                    size += len(part[-1])
                    hi += 1
                yield _encoded(ids.slice(lo, hi - lo), part, both)
                lo = hi

    cols = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return cols.mapInArrow(frugal(run, "alignment"), "doc_id long, " + ", ".join(f"{t}_{c} array<int>" for t in "ab" for c in ("ids", "lengths", "ends")))


def _loaded(a_source: Broadcast, b_source: Broadcast) -> tuple[ByteLevel, Pieces]:
    """One pair of tokenizers for each Python worker."""
    key = hashlib.md5(a_source.value.encode() + b_source.value).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteLevel(a_source.value), Pieces(b_source.value)
    return _LOADED[key]


def _encoded(ids: pa.Array, texts: list[str], both: tuple[ByteLevel, Pieces]) -> pa.RecordBatch:
    coded = [t.encode(texts) for t in both]
    columns, ok = [ids], []
    for text, *found in zip(texts, *coded):
        spaced = b" " + text.encode()
        ok.append(bool(text) and all(t.spelled(f) == spaced for t, f in zip(both, found)))
    for t, found in zip(both, coded):
        found = [f if o else [] for f, o in zip(found, ok)]
        sizes = np.array([len(f) for f in found])
        flat = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=sizes.sum())
        at = np.concatenate([[0], np.cumsum(sizes)])
        lengths = t.lengths[flat]
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        ends = ends[1:] - np.repeat(ends[at[:-1]], sizes)  # each text counts from its own start
        at = pa.array(at.astype(np.int32))
        columns += [pa.ListArray.from_arrays(at, pa.array(x)) for x in (flat, lengths, ends.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, schema=_TOKENS)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: names in lambdas hold values, while Spark may repeat a column's expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _last(token: str, cuts: Column) -> Column:
    """For each cut the place (from 0) of the token that ends there: a list of each byte's token, looked up at the cuts."""
    by_byte = F.flatten(F.transform(f"{token}_lengths", lambda n, i: F.array_repeat(i, n)))
    return _let(by_byte, lambda tokens: F.transform(cuts, lambda cut: F.get(tokens, cut - 1)))


class _Groups:
    """The groups of a row of `tokenize`. a and b hold the places of the tokens that end each group; codes a pair of ids,
    A's above B's, for a group of one token of each (most are), else the group's number, counted down from -1."""

    def __init__(self, a: Column, b: Column, codes: Column):
        self.a, self.b, self.codes = a, b, codes

    def ids(self, code: Column) -> list[Column]:
        """The A and B ids of a group of several tokens."""
        i = (-code - 1).cast("int")
        before = lambda last: F.coalesce(F.get(last, i - 1), F.lit(-1))
        return [F.slice(f"{t}_ids", before(last) + 2, F.get(last, i) - before(last)) for t, last in zip("ab", (self.a, self.b))]

    def links(self) -> Column:
        """A pair of ids for each A and B token occurrence of one group."""

        def more(code: Column) -> Column:
            xs, ys = self.ids(code)
            return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: _pair(x, y))))

        return F.concat(F.filter(self.codes, lambda c: c >= 0), F.flatten(F.transform(F.filter(self.codes, lambda c: c < 0), more)))

    def text(self) -> Column:
        """Groups as text: ids joined by commas, A's from B's by a bar, groups by semicolons."""

        def said(code: Column) -> Column:
            one = F.concat(F.shiftright(code, B_BITS).cast("string"), F.lit("|"), code.bitwiseAND(F.lit((1 << B_BITS) - 1)).cast("string"))
            more = F.concat_ws("|", *(F.array_join(ids.cast("array<string>"), ",") for ids in self.ids(code)))
            return F.when(code >= 0, one).otherwise(more)

        return F.array_join(F.transform(self.codes, said), ";")


def _pair(x: Column, y: Column) -> Column:
    return x * F.lit(1 << B_BITS).cast("long") + y


def with_groups(body: Callable[[_Groups], Column]) -> Column:
    """body of the groups of a row of `tokenize`, which are computed once."""

    def coded(a: Column, b: Column) -> Column:
        both = F.zip_with(a, b, lambda x, y: x + y)  # one token of each: this grows by 2
        single = lambda now, i, all_: now - F.when(i > 0, F.get(all_, i - 1)).otherwise(-2) == 2
        code = lambda i: _pair(F.get("a_ids", F.get(a, i)), F.get("b_ids", F.get(b, i)))
        codes = _let(both, lambda all_: F.transform(all_, lambda now, i: F.when(single(now, i, all_), code(i)).otherwise((-i - 1).cast("long"))))
        return _let(codes, lambda c: body(_Groups(a, b, c)))

    cut = lambda cuts: _let(_last("a", cuts), lambda a: _let(_last("b", cuts), lambda b: coded(a, b)))
    return _let(F.array_intersect("a_ends", "b_ends"), cut)


def align(tokens: DataFrame) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, groups_sha256, links) for each row of `tokenize`, as a written table."""
    n = {c: F.size(ids).cast("long").alias(c) for c, ids in (("n_a", "a_ids"), ("n_b", "b_ids"))}
    made = with_groups(lambda g: F.struct(F.size(g.codes).cast("long").alias("n_groups"), F.sha2(g.text(), 256).alias("sha"), g.links().alias("links")))
    cut = tokens.select("doc_id", *n.values(), made.alias("made"))
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.col("made.sha")).alias("groups_sha256")
    return materialize(cut.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "made.n_groups", digest, "made.links"), "align-links")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, docs, best): in how many documents each pair of ids is linked, and whether no pair of its A id is in more."""
    held = aligned.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    counted = materialize(held, "align-pairs")
    a_id = F.shiftright("pair", B_BITS).alias("a_id")
    most = counted.groupBy(a_id).agg(F.max("docs").alias("most"))
    return counted.select("pair", "docs", a_id).join(most, "a_id").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def pair_lookups(aligned: DataFrame) -> DataFrame:
    """(row, n_best, count_sum) over the links of each row that has any.

    A pair found in d documents adds d to the sum of all counts, so fewer than FREQUENT + 1 pairs can reach a count of
    that sum divided by FREQUENT. These are broadcast; as they make up most links, little is left for the shuffled join.
    """
    counts = materialize(pair_counts(aligned), "align-counts")
    total = counts.agg(F.sum("docs")).first()[0] or 0
    frequent = F.col("docs") * FREQUENT >= total
    linked = aligned.select("row", F.explode("links").alias("pair"))
    sums = [F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("docs").alias("count_sum")]
    top = counts.where(frequent)
    often = linked.join(F.broadcast(top), "pair").groupBy("row").agg(*sums)
    seldom = linked.join(F.broadcast(top.select("pair")), "pair", "left_anti").join(counts.where(~frequent), "pair").groupBy("row").agg(*sums)
    return often.unionByName(seldom).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment_report(docs: DataFrame, byte_bpe_path: str, piece_path: str) -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    aligned = align(tokenize(docs, byte_bpe_path, piece_path))
    sweep(docs.sparkSession)
    looked_up = pair_lookups(aligned)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return aligned.select("row", "doc_id", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), "groups_sha256").join(looked_up, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"
    )
