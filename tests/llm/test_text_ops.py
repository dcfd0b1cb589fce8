"""BPE, packing, WARC and exact dedup against the tokenizers library, exact round trips and brute force."""

import base64
import hashlib
import io
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vialytics.llm import bpe, exact_dedup, packing, warc

REPEATED = 19
SCHEMA = "doc_id long, text string, lang string, part string, _sha string"
ODD = [
    None, "", " ", "  \n\n x", "a b  c\x1cd\x85e", "it's we'll 123 4,5!!", "<|endoftext|>", "x<|endoftext|> y <|startoftext|>z", "<|ENDOFTEXT|> a<|StartOfText|>b <|endoftext|>", "<|endoftext|><|ENDOFTEXT|>",
    "é é ﬁ Σας İi", "日本語 テスト", "🙂🙂 a‍b", "\t tab\r\nline\n\n", "a" * 3000, "word " * 9000, "no space" + "é" * 500, "A b\tc", "A  b c", "A b c", "A b c",
]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    alphabet = "abcé ñ.,\n\t 1'\"-x　ß"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 200))) for _ in range(150)]
    rows = [(i, t, "en", "p", "s") for i, t in enumerate(texts)] + [(None, "A b c", None, None, None), (REPEATED, "A b c", "en", "p", "s"), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_bpe_equals_the_library(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    coded = bpe.encode(docs, path).collect()
    texts = sorted((r.text or "" for r in docs.collect()))
    assert sorted(map(tuple, (r.ids for r in coded))) == sorted(tuple(lib.encode(t, add_special_tokens=False).ids) for t in texts)
    back = bpe.decode(bpe.encode(docs, path), path).collect()
    assert sorted(r.text for r in back) == texts
    of = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe.round_trip_digests(docs.where("doc_id is not null"), path).collect():
        ids = lib.encode(of[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip_digests(docs.limit(0), path).count() == 0


def test_packing_is_gapless_and_whole(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, with_ids=True).collect()
    sequences, whole = {}, {}
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), dtype="<u4")
        assert r.length == len(ids) and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        whole.setdefault(r.doc_id, []).append((r.start, ids.tolist(), r.doc_tokens))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    want = {r.doc_id: lib.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect() if r.doc_id not in (None, REPEATED)}
    for i, ids in want.items():
        assert sum((p[1] for p in sorted(whole[i])), []) == ids and {p[2] for p in whole[i]} == {len(ids)}
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_packing_deals_equal_rows_to_many_groups(spark):
    items = spark.range(4000).selectExpr("1 as `_group0`", "'x' as _number", "cast(1000 as long) as length")
    got = packing.pack(items, group_size=100).collect()
    assert got[0].asDict().keys() == {"_group0", "_number", "length", "sequence_id", "offset"}
    groups = {}
    for r in got:
        groups[r.sequence_id % 40] = groups.get(r.sequence_id % 40, 0) + 1
    assert len(groups) == 40 and max(groups.values()) < 200 and len({(r.sequence_id, r.offset) for r in got}) == 4000


def test_first_fit_decreasing_equals_a_plain_scan():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 50, 300):
        lengths = np.array([rng.randrange(0, 101) for _ in range(n)], dtype=np.int64)
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        room = [100] * n
        for i in np.argsort(-lengths, kind="stable").tolist():
            b = next(k for k in range(n) if room[k] >= lengths[i])
            assert bins[i] == b and offsets[i] == 100 - room[b]
            room[b] -= int(lengths[i])


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "<p>x</p>", 1), (2, "http://b/", "<p>x</p>", 1), (3, None, None, 2), (4, "u\r\nv", "", 2), (None, "n", "<p>x</p>", 3), (5, "z", "é" * 50000, 1)]
    rows += [(5, "z", "é" * 50000, 1)] + [(10 + i, f"http://c/{i}", f"<html>{i % 40} same words again</html>", 0) for i in range(100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, row long").repartition(2)
    got = warc.read_archives(warc.write_archives(pages)).collect()
    assert len(got) == len(rows)
    best = {}
    for i, _, h, _ in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    seen = {}
    for r in got:
        html = next((h or "") for i, u, h, _ in rows if i == r.page_id)
        payload = html.encode()
        assert r.payload_bytes == len(payload) and r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert r.html == (html if r.record_type == "response" else None)
        assert r.refers_to == (best[html] if r.record_type == "revisit" else None)
        seen[html] = seen.get(html, 0) + (r.record_type == "response")
    assert set(seen.values()) == {1}
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
    response, revisit = (warc.record_bytes(k, u, i, b"same", t, tu) for k, u, i, t, tu in (("response", "u", 1, None, None), ("revisit", "v", 0, 1, "u")))
    made, again = ([h for h, _ in warc.read_records(io.BytesIO(warc.archive_bytes([warc.info_bytes("x"), r])))] for r in (response, revisit))
    assert made[0]["WARC-Type"] == "warcinfo" and again[1]["WARC-Refers-To"] == made[1]["WARC-Record-ID"] and again[1]["WARC-Refers-To-Target-URI"] == "u"
    records = [warc.record_bytes("response", "u", i, b"page %d" % i * 20, None) for i in range(300)]
    again = list(warc.read_records(io.BytesIO(warc.archive_bytes(records))))
    assert [h["X-Page-Id"] for h, _ in again] == [str(i) for i in range(300)]


def test_golomb_codes():
    rng = np.random.default_rng(2)
    for n, k in ((0, 3), (1, 0), (5, 0), (1000, 7), (1000, 0)):
        values = np.sort(rng.integers(0, 5 * n << k, n)) if n else np.zeros(0, dtype=np.int64)
        assert np.array_equal(exact_dedup.golomb_decode(exact_dedup.golomb_encode(values, k), k, n), values)


def test_exact_dedup_against_brute_force(docs):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups, rows = {}, docs.collect()
    for r in rows:
        groups.setdefault(norm(r.text), []).append(r.doc_id)
    want = sorted(
        ((i if i is not None else -1), min((x for x in g if x is not None), default=-1), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g
    )
    got = exact_dedup.exact_groups(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.keep_id is None else r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0
