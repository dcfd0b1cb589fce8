"""The pipeline against a plain version: what its first stage keeps goes through brute force, stage by stage."""

import re

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from vialytics.llm.common import materialize, table

from .test_joins import brute

SF_DIR = "/root/testdata/sf0.001"


def without_repeats(docs, least=25):
    """docs (id, text): sentences go that a run seen before covers; texts of which nothing stays go."""
    cut, occurrences = {}, {}
    for i, text in sorted(docs):
        parts = re.findall(r".+?(?:[.!?]+[\"')\]]*\s+|\n+|\Z)", text, re.S) if text else []
        cut[i] = parts
        words = [p.lower().split() for p in parts]
        used = [k for k, w in enumerate(words) if w]
        spans = set()
        for a in range(len(used)):  # every run of several sentences, or of one long one
            n = 0
            for b in range(a, len(used)):
                n += len(words[used[b]])
                if n >= (least if b > a else 2 * least):
                    spans.add((a, b))
                    if b > a and n >= 4 * least:
                        break
        for a, b in sorted(spans):
            key = " ".join(w for k in used[a : b + 1] for w in words[k])
            occurrences.setdefault(key, []).append((i, used[a], used[b]))
    gone = {(i, k) for found in occurrences.values() for i, a, b in found[1:] for k in range(a, b + 1)}
    out = {}
    for i, text in docs:
        left = "".join(p for k, p in enumerate(cut[i]) if (i, k) not in gone)
        if left.strip(" ") or left == (text or ""):
            out[i] = left
    return out


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF_DIR, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF_DIR), f"test-{name}")
        out.append(docs)
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_toxic_documents_go_and_others_stay(stages):
    kept = {i for i, _ in texts(stages[0])}
    documents, labels = (pq.read_table(f"{SF_DIR}/{n}.parquet").to_pylist() for n in ("documents", "labels"))
    assert kept <= {d["doc_id"] for d in documents}
    toxic, clean = ({x["doc_id"] for x in labels if x["toxic"] == k} for k in (1, 0))
    assert len(toxic & kept) <= 0.2 * len(toxic) and len(clean & kept) >= 0.95 * len(clean)


def test_each_stage_equals_brute_force(stages):
    first = {}
    for i, t in sorted(texts(stages[0])):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
    assert {i for i, _ in texts(stages[1])} == set(first.values())
    one = brute(texts(stages[1]), 5, 0.8)[1]
    assert {i for i, _ in texts(stages[2])} == {i for i, c in one.items() if i == c}
    cleaned = without_repeats(texts(stages[2]))
    assert {i: t or "" for i, t in texts(stages[3])} == cleaned
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.no_truncation()
    lib.no_padding()
    sequences, pieces = {}, {}
    for r in stages[4].collect():
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    assert set(pieces) == {(i, len(lib.encode(t, add_special_tokens=False).ids) + 1) for i, t in cleaned.items()}
    for (_, total), parts in pieces.items():
        assert [a for a, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) == total
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096


def test_stages_but_the_last_return_the_columns_of_documents(spark, stages):
    for df in stages[:-1]:
        assert df.columns == table(spark, SF_DIR, "documents").columns


COLUMNS = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_empty_tables_nulls_and_clashing_names(spark, tmp_path, name, stage):
    spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 0), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, None, None, None, None), (None, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "a b c " * 30, "en", "s", 180), (3, "a b c " * 30, "en", "s", 180), (4, "word " * 30_000, None, "s", 1)]
    extra = "1 as row, 2 as id, 3 as th, 4 as key, 5 as left, 6 as _sid, 7 as `_group0`, 8 as _gone, 9 as _score0, 10 as sha, 11 as spans, 12 as length, 13 as component_id, 14 as _key"
    docs = spark.createDataFrame(rows, COLUMNS).selectExpr("*", *extra.split(", ")).repartition(2)
    for frame in (docs, docs.limit(0)):
        out = stage(spark, frame, str(tmp_path))
        n = out.count()
        assert name == "packing" or out.columns == docs.columns
        assert n == 0 if frame is not docs else n > 2
