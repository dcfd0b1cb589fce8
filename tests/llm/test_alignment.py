"""Cross-tokenizer alignment against the two libraries and plain loops."""

import hashlib
import json
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from vialytics.llm import alignment
from vialytics.llm.bpe import byte_letters

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", "hello world, hello worlds", "x▁y", "a  b   c \n\n d\t\te ", " lead", "<|endoftext|> <s></s> <unk> <0x41>", "日本語 テスト 🙂🙂", "naïve Σας İi ﬁ", "it's we'll 123,456!!", "word " * 3000,
    "ab\x00c", "\x1c\x85　x", "é é", "a" * 500, "hello world, hello worlds", "line\r\nline x", "zzqx" * 90,
]


def plain(rows):
    """(doc_id, text) -> the report's rows, by the libraries and loops."""
    tok, sp = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    tok.encode_special_tokens = True
    of = {c: b for b, c in enumerate(byte_letters())}
    a_bytes = {i: bytes(of[c] for c in s) for s, i in json.load(open(PATHS[0]))["model"]["vocab"].items()}
    links, out = [], []
    for doc_id, text in rows:
        spaced = (" " + (text or "")).encode()
        a = tok.encode(spaced.decode(), add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        ab = [a_bytes[i] for i in a]
        bb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(ab) != spaced or b"".join(bb) != spaced:
            out.append([doc_id, 0, 0, 0, 0, 0, 0, ""])
            links.append(Counter())
            continue
        ends = []
        for parts in (ab, bb):
            at, e = 0, []
            for p in parts:
                at += len(p)
                e.append(at)
            ends.append(e)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        made, lo, found = [], 0, Counter()
        for c in cuts:
            g = [[i for i, e in zip(ids, es) if lo < e <= c] for ids, es in zip((a, b), ends)] if len(a) < 200 else None
            if g is None:
                i0, i1 = sum(e <= lo for e in ends[0]), sum(e <= c for e in ends[0])
                j0, j1 = sum(e <= lo for e in ends[1]), sum(e <= c for e in ends[1])
                g = [a[i0:i1], b[j0:j1]]
            made.append(g)
            found.update((x, y) for x in g[0] for y in g[1])
            lo = c
        said = ";".join("|".join(",".join(map(str, x)) for x in g) for g in made)
        out.append([doc_id, len(a), len(b), len(made), sum(found.values()), 0, 0, hashlib.sha256(said.encode()).hexdigest()])
        links.append(found)
    docs = Counter(p for f in links for p in f)
    most = defaultdict(int)
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    for row, f in zip(out, links):
        row[5] = sum(n for p, n in f.items() if docs[p] == most[p[0]])
        row[6] = sum(n * docs[p] for p, n in f.items())
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 20])
def test_report_equals_plain_loops(spark, monkeypatch, frequent):
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    monkeypatch.setattr(alignment, "SLICE", 300)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "a"), (3, "a"), (None, "hello")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, row string, links int").repartition(3)
    got = alignment.alignment_report(docs, *PATHS)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_empty_table_and_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert alignment.alignment_report(docs.limit(0), *PATHS).count() == 0
    some = docs.orderBy("n_chars").limit(60)
    assert sorted(map(tuple, alignment.alignment_report(some, *PATHS).collect()), key=str) == plain([(r.doc_id, r.text) for r in some.collect()])
