"""Token counts: rollups by source, language and tokenizer version that signed changes keep up to date.

Totals are additive. A batch of inserts, deletes and revised counts is folded to one signed row for each group and
written to a draft folder. A marker file named by the batch, which only one writer can make, names the draft that counts.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import loaded, read_tokenizer
from .common import arrow_rows, batches, frugal, materialize, shared_path

KEYS = ["source", "lang", "tokenizer"]
#: What a change does: the sign of a document and its tokens.
INSERT, DELETE = 1, -1


def _keyed_counts(docs: DataFrame, tokenizer_path: str, version: str) -> DataFrame:
    """token_counts with key, a hash of the text; null text and empty text have the same."""
    sent = read_tokenizer(docs, tokenizer_path)
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("n_tokens", pa.int64()), ("key", pa.binary())])

    def run(it):
        bpe = loaded(sent)
        for ids, sources, langs, texts in batches(it, "doc_id", "source", "lang", "text"):
            texts = [t.as_py() or "" for t in texts]
            counts = [c.count(",") + 1 if (c := bpe.encode(t)) else 0 for t in texts]
            keys = [hashlib.sha256(t.encode()).digest() for t in texts]
            yield arrow_rows(schema, doc_id=ids, source=sources, lang=langs, n_tokens=counts, key=keys)

    cols = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(source as string) as source", "cast(lang as string) as lang", "cast(text as string) as text")
    counted = cols.mapInArrow(frugal(run), "doc_id long, source string, lang string, n_tokens long, key binary")
    return counted.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), "n_tokens", "key")


def token_counts(docs: DataFrame, tokenizer_path: str, version: str) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens) of each row: byte-level BPE ids of the whole text; null text has none."""
    return _keyed_counts(docs, tokenizer_path, version).drop("key")


def inserts(counts: DataFrame) -> DataFrame:
    """Changes (keys, sign, n_tokens) that add documents."""
    return counts.select(*KEYS, F.lit(INSERT).alias("sign"), "n_tokens")


def deletes(counts: DataFrame) -> DataFrame:
    """Changes that take documents away, with the counts they were added with."""
    return counts.select(*KEYS, F.lit(DELETE).alias("sign"), "n_tokens")


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes that replace counts, or move documents between groups: the old rows go, the new ones come."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """A rollup in a folder that all executors share. Null keys are groups of their own; null counts are 0 tokens."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, (folder or shared_path(spark, "rollup")).rstrip("/")

    def _path(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _claim(self, name: str, content: str) -> bool:
        """Make the file `name` with its content as one step; False if it is there already, also when two writers try at once."""
        jvm = self.spark._jvm
        draft, files = self._path(f"claims/{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(content.encode())
        out.close()
        final, _ = self._path(name)
        files.mkdirs(final.getParent())
        try:
            if files.getScheme() == "file":  # a rename replaces what is there on local disks, a link does not
                jvm.java.nio.file.Files.createLink(*(jvm.java.nio.file.Path.of(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)) for p in (final, draft)))
            else:
                kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
                once = self.spark.sparkContext._gateway.new_array(kind, 1)
                once[0] = kind.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, once)
            return True
        except Py4JJavaError as e:
            if not files.exists(final):
                raise OSError(f"{name} could not be committed") from e
            return False
        finally:
            files.delete(draft, False)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of changes; False if a batch of that name was committed before, which then counts once.

        The sums are written to a draft folder of their own; the marker that names it is made in one step. A batch that
        fails half way leaves no marker and does not count, and of two writers of one batch one makes the marker.
        """
        name = "markers/" + hashlib.sha256(batch.encode()).hexdigest()[:32]
        path, files = self._path(name)
        if files.exists(path):
            return False
        signed = changes.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * F.coalesce("n_tokens", F.lit(0))).cast("long").alias("tokens"))
        draft = f"drafts/{uuid.uuid4().hex}"
        signed.write.parquet(f"{self.folder}/{draft}")
        if self._claim(name, draft):
            return True
        files.delete(self._path(draft)[0], True)
        return False

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens): the sums over all batches; groups of which nothing is left are not listed."""
        schema = "source string, lang string, tokenizer string, docs long, tokens long"
        path, files = self._path("markers")
        markers = files.listStatus(path) if files.exists(path) else []
        drafts = []  # one short line for each batch
        for m in markers:
            stream = files.open(m.getPath())
            drafts.append(bytes(stream.readAllBytes()).decode())
            stream.close()
        if not drafts:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*(f"{self.folder}/{d}" for d in drafts))
        sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 or tokens <> 0")


def corpus_rollup(docs: DataFrame, tokenizer_path: str, version: str, folder: str | None = None, whole: bool = False) -> Rollup:
    """The rollup of docs (doc_id, text, source, lang) after four batches over the whole table, and a fifth if whole.

    All documents are inserted; those whose text is the same as that of a row with a smaller id (null ids come last) are
    deleted; the counts of all others are revised to a version `<version>+end` that adds an end-of-text token; the
    revision is sent again, which changes nothing. Rows that repeat an id and its text are deleted alike; rows that only
    repeat an id, or have none, are judged by their own texts. The fifth batch adds what the others took away: then the
    totals of both versions are those of all documents.
    """
    spark = docs.sparkSession
    counts = materialize(_keyed_counts(docs, tokenizer_path, version), "token-counts")
    firsts = materialize(counts.groupBy("key").agg(F.min("doc_id").alias("first")), "first-copies")
    gone = ~F.col("doc_id").eqNullSafe(F.col("first"))
    flagged = materialize(counts.join(firsts, "key").select("source", "lang", "tokenizer", "n_tokens", gone.alias("gone")), "flagged")
    copies, left = flagged.where("gone"), flagged.where(~F.col("gone"))

    def revised(rows):
        return rows.select("source", "lang", F.lit(f"{version}+end").alias("tokenizer"), (F.col("n_tokens") + 1).alias("n_tokens"))

    rollup = Rollup(spark, folder)
    rollup.commit("insert", inserts(counts))
    rollup.commit("delete copies", deletes(copies))
    for _ in range(2):
        rollup.commit("revise", revisions(left, revised(left)))
    if whole:
        rollup.commit("restore", inserts(flagged).unionByName(inserts(revised(copies))))
    return rollup
