"""Substring dedup with sliding sentence spans.

A run is several consecutive sentences, or one sentence of at least LONE_WORDS words. A caller may ask for runs of at
least so many words together; by default every run of two sentences counts, however short. Runs are hashed to 128 bits, meet by hash over the whole corpus, and the sentences that any occurrence but the first covers
go. Only the shortest runs from each sentence forwards and backwards are sent: every longer run is a union of those
inside it, and where it repeats an earlier run so do they.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, batches, frugal, give_back, materialize

#: Sentences of a run, the least words of them together, and of a sentence that is a run by itself.
RUN_SENTENCES, RUN_WORDS, LONE_WORDS = 2, 0, 50
FLUSH_RUNS = 150_000
#: Owners for each task: a task holds the runs of one owner at a time.
OWNERS = 8
#: A sentence ends after closing punctuation with white space behind it (none behind full-width stops), or at a line's end.
ENDS = re.compile(r"[.!?]+[\"')\]]*\s+|[。！？．]+[”’」』）]*\s*|\n+")
#: Scripts without spaces between words: each of their characters counts as a word.
UNSPACED = re.compile(r"[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
#: Stands for a null id, so that documents without an id come last.
NO_ID = (1 << 63) - 1
_MESSAGE = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
_GONE = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
_RUN = np.dtype([("hash", "<u8"), ("more", "<u8"), ("id", "<i8"), ("th", "<i8"), ("lo", "<i4"), ("hi", "<i4")])
RUNS, REPEATED = 0, 1


def sentences(text: str) -> list[str]:
    """The text cut at sentence ends; joined again they are the text."""
    cut = [0, *(m.end() for m in ENDS.finditer(text))]
    if cut[-1] != len(text):
        cut.append(len(text))
    return [text[a:b] for a, b in zip(cut, cut[1:])]


def runs(parts: list[str], least: int = RUN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes (n, 2), first sentence, sentence behind the last) of each run; words compare in lower case, white space does not count."""
    words = [p.lower().split() for p in parts]
    used = [i for i, w in enumerate(words) if w]
    if not used:
        return (np.zeros((0, 2), dtype=np.uint64),) + (np.zeros(0, dtype=np.int32),) * 2
    joined = [" ".join(words[i]) for i in used]
    count = np.array([len(words[i]) + (len(UNSPACED.findall(x)) if not x.isascii() else 0) for i, x in zip(used, joined)])
    total = np.concatenate([[0], np.cumsum(count)])
    n = len(used)
    i = np.arange(n)
    forward = np.maximum(np.searchsorted(total, total[:-1] + least), i + RUN_SENTENCES)  # the shortest runs from i are [i, forward[i])
    backward = np.minimum(np.searchsorted(total, total[1:] - least, side="right") - 1, i + 1 - RUN_SENTENCES)
    lone = np.flatnonzero(count >= LONE_WORDS)
    spans = np.concatenate([np.stack([i, forward])[:, forward <= n], np.stack([backward, i + 1])[:, backward >= 0], np.stack([lone, lone + 1])], axis=1)
    spans = np.unique(spans, axis=1) if spans.shape[1] else spans
    place = np.array([*used, len(parts)], dtype=np.int32)
    digests = b"".join([xxhash.xxh3_128_digest(" ".join(joined[a:b])) for a, b in spans.T.tolist()])
    return np.frombuffer(digests, dtype="<u8").reshape(-1, 2), place[spans[0]], place[spans[1] - 1] + np.int32(1)


def _split(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first occurrence of each hash, the others); first is the smallest (id, text hash, place)."""
    rows = rows[np.lexsort((rows["lo"], rows["th"], rows["id"], rows["more"], rows["hash"]))]
    if not len(rows):
        return rows, rows
    head = np.concatenate([[True], (rows["hash"][1:] != rows["hash"][:-1]) | (rows["more"][1:] != rows["more"][:-1])])
    firsts = rows[head][np.cumsum(head) - 1]
    same = (firsts["id"] == rows["id"]) & (firsts["th"] == rows["th"]) & (firsts["lo"] == rows["lo"])  # a repeated row
    return rows[head], rows[~head & ~same]


def _scan(buckets: int, least: int):
    def run(it):
        held, size, serial = [], 0, TaskContext.get().partitionId() * 31

        def flush():
            nonlocal serial
            first, again = _split(np.concatenate(held))
            owner = (((first["hash"] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
            cut = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1, [len(owner)]])
            rows = [(int(owner[a]), RUNS, first[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:])]
            serial += 1
            if len(again):
                rows.append((serial % buckets, REPEATED, again.tobytes()))
            for lo in range(0, len(rows), 64):
                o, k, p = zip(*rows[lo : lo + 64])
                yield arrow_rows(_MESSAGE, bucket=o, kind=k, payload=p)

        for ids, ths, texts in batches(it, "id", "th", "text"):
            for d, th, t in zip(ids.to_pylist(), ths.to_pylist(), texts):
                h, lo, hi = runs(sentences(t.as_py()), least)
                if not len(h):
                    continue
                rows = np.empty(len(h), dtype=_RUN)
                rows["hash"], rows["more"], rows["id"], rows["th"], rows["lo"], rows["hi"] = *h.T, d, th, lo, hi
                held.append(rows)
                size += len(h)
                if size >= FLUSH_RUNS:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def _gone(rows: np.ndarray):
    for lo in range(0, len(rows), 50_000):
        part = rows[lo : lo + 50_000]
        yield arrow_rows(_GONE, **{n: np.ascontiguousarray(part[n]) for n in ("id", "th", "lo", "hi")})


def _own(it):
    """Messages sorted by owner: every occurrence but the first of each hash. The runs of one owner are held at a time."""
    owner, first = None, []
    for buckets, kinds, payloads in batches(it, "bucket", "kind", "payload"):
        for bucket, k, p in zip(buckets.to_pylist(), kinds.to_pylist(), payloads):
            rows = np.frombuffer(p.as_py(), dtype=_RUN)
            if k == REPEATED:
                yield from _gone(rows)
                continue
            if bucket != owner:
                if first:
                    yield from _gone(_split(np.concatenate(first))[1])
                owner, first = bucket, []
            first.append(rows)
    if first:
        yield from _gone(_split(np.concatenate(first))[1])


def _cut_texts(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without the sentences of their spans; null where there are no spans."""
    out = []
    for text, gone in zip(texts, spans):
        if (gone := gone.as_py()) is None:
            out.append(None)
            continue
        parts = sentences(text.as_py())
        keep = np.ones(len(parts), dtype=bool)
        for s in gone:
            keep[s["lo"] : s["hi"]] = False
        out.append("".join(p for p, k in zip(parts, keep) if k))
    out = pa.array(out, type=pa.string())
    give_back()
    return out


def _cut(rows):
    schema = pa.schema(
        [("id", pa.int64()), ("th", pa.int64()), ("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.list_(pa.int64()))), ("text", pa.string())]
    )

    def run(it):
        for ids, ths, texts, spans in batches(it, "id", "th", "text", "spans"):
            out = []
            for d, th, t, gone in zip(ids.to_pylist(), ths.to_pylist(), texts, spans):
                text, gone = t.as_py(), gone.as_py()
                parts = sentences(text)
                if not gone:
                    out.append((d, th, len(parts), 0, [], text))
                    continue
                keep = np.ones(len(parts), dtype=bool)
                for s in gone:
                    keep[s["lo"] : s["hi"]] = False
                at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
                edge = np.flatnonzero(np.diff(np.concatenate([[True], keep, [True]]).astype(np.int8)))
                cuts = [[int(at[a]), int(at[b])] for a, b in zip(edge[::2], edge[1::2])]
                out.append((d, th, len(parts), int((~keep).sum()), cuts, "".join(p for p, k in zip(parts, keep) if k)))
            for lo in range(0, len(out), 500):
                yield arrow_rows(schema, **dict(zip(schema.names, zip(*out[lo : lo + 500]))))

    return rows.mapInArrow(frugal(run), "id long, th long, n_sentences long, n_removed long, removed array<array<long>>, text string")


def _keys(docs: DataFrame) -> list:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text")]


def repeated_spans(docs: DataFrame, least_words: int = RUN_WORDS) -> DataFrame:
    """(id, th, spans): the sentence ranges of each text that repeat an earlier occurrence; th is the text's hash."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = docs.select(*_keys(docs)).mapInArrow(frugal(_scan(OWNERS * parts, least_words)), "bucket int, kind int, payload binary")
    gone = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(frugal(_own), "id long, th long, lo int, hi int")
    return materialize(gone.groupBy("id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")


def remove_repeats(docs: DataFrame, least_words: int = RUN_WORDS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_sentences, n_removed, removed (character ranges), text (what stays).

    Of all occurrences of a run the first, by (doc_id, place), stays. Null text is empty text and loses nothing; null
    doc_ids come after all others. Rows that repeat a doc_id and its text are one document and lose alike. Texts of fewer
    than least_words words have no run, nor have texts of one sentence with fewer than LONE_WORDS. Every other column
    is ignored; an empty table gives an empty result.
    """
    spans = repeated_spans(docs, least_words)
    left = docs.select(*_keys(docs)).join(spans, ["id", "th"], "left")
    out = _cut(left.select("id", "th", "text", "spans"))
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_sentences", "n_removed", "removed", "text")


def clean(docs: DataFrame, least_words: int = RUN_WORDS) -> DataFrame:
    """The rows of docs with repeated passages cut out of their texts, all columns; rows of which nothing stays go.

    n_chars, where there is such a column, is counted anew. A row whose text was empty before stays.
    """
    spans = repeated_spans(docs, least_words).withColumnsRenamed({"id": "_sid", "th": "_sth"})
    key, th, _ = _keys(docs)
    rows = docs.select(F.struct("*").alias("row"), key, th)
    hit = rows.join(spans, (rows["id"] == spans["_sid"]) & (rows["th"] == spans["_sth"]), "left")
    whole = F.when(F.col("spans").isNotNull(), F.coalesce(F.col("row.text").cast("string"), F.lit("")))  # only these go to Python
    done = hit.withColumn("left", F.arrow_udf(_cut_texts, "string")(whole, F.col("spans")))
    done = done.where(F.col("spans").isNull() | (F.trim("left") != ""))
    cols = []
    for c in docs.columns:
        kept = F.col(f"row.`{c}`")
        if c.lower() == "text":
            kept = F.when(F.col("spans").isNull(), kept).otherwise(F.col("left"))
        elif c.lower() == "n_chars":
            kept = F.when(F.col("spans").isNull(), kept).otherwise(F.length("left").cast(docs.schema[c].dataType))
        cols.append(kept.alias(c))
    return done.select(*cols)
