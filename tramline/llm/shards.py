"""Token-id shards in training order.

Documents become byte-level BPE ids and are cut into sequences of ``length`` ids that never cross documents.  The N sequences
are numbered in corpus order, which for a table of files is that of file paths and rows in them, however tasks split the files (a
table that isn't read from files is numbered in the order of its tasks); a keyed Feistel network over the next power of two, walked until it lands below N, permutes the
numbers, so that every sequence owns one slot of the training order and the order is a function of (N, key).  Range
partitions of the slots write the shards: files of fixed-stride records, so that record ``i`` of a shard starts at byte
``i * stride`` and a reader can resume at any slot by arithmetic.

A record is ``length`` little-endian ids (2 bytes where the vocabulary fits, else 4), padded with ``pad``, and one newline
byte; the folder ``_layout`` beside the shards says which numbers these are.  The ids are tokenised once, into a stored table; the only shuffle moves each sequence to its range.

Defined results: null and empty texts have no ids and no sequence; repeated rows are separate sequences; a null id is carried as null;
very long texts become many sequences; an empty table gives no shards.  Columns beyond ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.llm.common import in_batches, shared_folder, stored, swept

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # of that vocabulary
LENGTH, SHARD_RECORDS, ROUNDS, WAVES = 512, 4096, 6, 3
LAYOUT = "length int, width int, shard_records int, pad int, sequences long"
RUN_BITS = 20  # runs of one task: the stretches of files that it reads
ROWS_OUT = 512  # sequences in one Arrow batch
_ENCODERS: dict[str, object] = {}  # one per Python worker


def encoder(ranks: bytes, pattern: str = PATTERN):
    """The tokenizer of a ``.tiktoken`` rank file's bytes, built once per worker."""
    import tiktoken

    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _ENCODERS:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        _ENCODERS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[key]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """Slots of ``index`` under the keyed permutation of ``range(n)``."""
    bits = max(2, int(n - 1).bit_length())
    low, high = bits // 2, bits - bits // 2  # an unbalanced network alternates the two widths
    keys = [int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little") for r in range(rounds)]

    def once(x: np.ndarray) -> np.ndarray:
        a, b = low, high
        for k in keys:
            left, right = x >> np.uint64(b), x & np.uint64((1 << b) - 1)
            left ^= _mix(right ^ np.uint64(k)) & np.uint64((1 << a) - 1)
            x = (right << np.uint64(a)) | left
            a, b = b, a
        return x

    x = once(np.asarray(index).astype(np.uint64))
    while len(out := np.nonzero(x >= np.uint64(n))[0]):
        x[out] = once(x[out])
    return x.astype(np.int64)


def _placed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, _file, _start``: the file and the start of the stretch of it that a task reads, or nulls without files."""
    plain = docs.select("doc_id", "text", F.lit(None).cast("string").alias("_file"), F.lit(None).cast("long").alias("_start"))
    # The hidden column is asked for as such, since the table may have one of that name; a table without files has none.
    try:
        hidden = docs.metadataColumn("_metadata")
        return docs.select("doc_id", "text", hidden["file_path"].alias("_file"), hidden["file_block_start"].alias("_start"))
    except AnalysisException as e:
        if not (e.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
            raise
        return plain


def sequences(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH) -> tuple[DataFrame, int, np.dtype]:
    """The stored table of sequences: run of rows (its file and where it starts there), position in the run, document, number, ids;
    also the pad id and id type.  A run is a stretch of a file that one task reads; its rows come in their order."""
    raw = Path(vocabulary).read_bytes()
    if len(raw) > 64 << 20:
        raise ValueError("a vocabulary of over 64 MB isn't broadcast")
    pad = max(int(line.split()[1]) for line in raw.splitlines() if line) + 1
    kind = np.dtype("<u2" if pad < 1 << 16 else "<u4")
    held = docs.sparkSession.sparkContext.broadcast(raw)
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType.fromDDL("run long, file string, first long, at long, doc_id long, seq_no long, n_ids int, ids binary")
    schema["doc_id"].dataType = id_type

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(held.value).encode_ordinary
        run = (TaskContext.get().partitionId() << RUN_BITS) - 1
        file = first = at = None

        def cut(batch: pa.RecordBatch) -> Iterator[tuple]:
            nonlocal run, file, first, at
            for doc_id, text, own, start in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if at is None or (own, start) != (file, first):
                    run, file, first, at = run + 1, own, start, itertools.count()
                text = text.as_py()
                if text:
                    ids = np.array([*encode(text), pad], kind)
                    for seq, cut_at in enumerate(range(0, len(ids), length)):
                        part = ids[cut_at : cut_at + length]
                        yield run, file, first, next(at), doc_id.as_py(), seq, len(part), part.tobytes()

        for batch in batches:
            rows = cut(batch)
            while some := list(itertools.islice(rows, ROWS_OUT)):
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), batch.schema.field(0).type, pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds, strict=True)], names=schema.names)

    return stored(in_batches(_placed(docs), tokenise, schema), "sequences"), pad, kind


def materialise(docs: DataFrame, key: int = 1, vocabulary: str = VOCABULARY, length: int = LENGTH, shard_records: int = SHARD_RECORDS, path: str | None = None, waves: int = WAVES) -> tuple[str, DataFrame]:
    """Write the shards of ``docs``; returns their folder and the index: which sequence has which slot, shard and offset.

    The sequence numbers follow the files and rows of the table; per run (as many as input splits) of the one tokenising pass only a count reaches the driver.
    The shuffle to the ranges runs in ``waves`` of consecutive shards, each of which frees its shuffle files before the next
    begins, so that scratch space holds a part of the ids at a time beside the stored sequences and the shards.
    """
    spark = docs.sparkSession
    path = path or shared_folder(spark, "shards")
    seqs, pad, kind = sequences(docs, vocabulary, length)
    counts = seqs.groupBy("run").agg(F.min("file").alias("file"), F.min("first").alias("first"), F.count(F.lit(1)).alias("n")).collect()
    counts = sorted((r["file"] or "", r["first"] or 0, r["run"], r["n"]) for r in counts)
    offsets = dict(zip([c[2] for c in counts], itertools.accumulate([0, *[c[3] for c in counts]]), strict=False))
    n = sum(c[3] for c in counts)
    stride = length * kind.itemsize + 1
    own = spark.range(1).select(*[F.lit(v).alias(k) for k, v in (("length", length), ("width", kind.itemsize), ("shard_records", shard_records), ("pad", pad), ("sequences", n))])
    own.coalesce(1).write.json(f"{path}/_layout")
    if not n:
        empty = seqs.select("doc_id", "seq_no", "n_ids", F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("byte_offset"))
        return path, empty

    @F.pandas_udf("long")
    def slot(run, at):
        import pandas as pd

        return pd.Series(permute(run.map(offsets).to_numpy() + at.to_numpy(), n, key))

    # Called non-deterministic, though it is not, so that a filter on slots or shards doesn't evaluate it, and pass all ids by it, a second time.
    slot = slot.asNondeterministic()
    placed = seqs.withColumn("slot", slot("run", "at")).withColumn("shard", F.expr(f"slot div {shard_records}"))
    filler = np.full(length, pad, kind).tobytes()
    record = F.concat("ids", F.substring(F.lit(filler), 1, F.lit(length * kind.itemsize) - F.length("ids")))
    shards = -(-n // shard_records)
    waves = max(1, min(waves, shards))
    for w in range(waves):
        low, high = shards * w // waves, shards * (w + 1) // waves
        parts = max(1, min(high - low, int(spark.conf.get("spark.sql.shuffle.partitions")) * 8))
        own = placed.filter((F.col("shard") >= low) & (F.col("shard") < high)).select("shard", "slot", record.alias("r"))
        # Slots are dense, so the ranges are known: equal stretches of shards, without sampling for their bounds.
        ranged = own.repartitionById(parts, F.expr(f"cast((shard - {low}) * {parts} div {high - low} as int)")).sortWithinPartitions("shard", "slot")
        with swept(spark):
            ranged.select(F.col("r").cast("string").alias("value"), "shard").write.mode("append").partitionBy("shard").option("lineSep", "\n").text(path)
    index = placed.select("doc_id", "seq_no", "n_ids", "slot", "shard", (F.pmod("slot", F.lit(shard_records)) * stride).alias("byte_offset"))
    return path, index


def layout(spark: SparkSession, path: str) -> dict[str, int]:
    """What a reader of the shards in ``path`` must know: ``length``, ``width`` (bytes of an id), ``shard_records``, ``pad``, ``sequences``."""
    return spark.read.schema(LAYOUT).json(f"{path}/_layout").first().asDict()


def read(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """``slot, ids`` from the shards, from slot ``start`` on; earlier shards are not opened."""
    own = layout(spark, path)
    shard_records, stride = own["shard_records"], own["length"] * own["width"] + 1
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary, shard long").load(path)
    files = files.filter(F.col("shard") >= start // shard_records).select("shard", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0), batch.column(1), strict=True):
                data, first = content.as_buffer(), shard.as_py() * shard_records
                for at in range(0, data.size // stride, ROWS_OUT):
                    slots = range(max(start, first + at), min(first + at + ROWS_OUT, first + data.size // stride))
                    ids = [data.slice((s - first) * stride, stride - 1).to_pybytes() for s in slots]
                    yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(ids, pa.binary())], ["slot", "ids"])

    return in_batches(files, run, "slot long, ids binary")


def training_order(docs: DataFrame, **options) -> DataFrame:
    """The index of the shards written for ``docs``, with the SHA-256 of every record as read back from its shard."""
    path, index = materialise(docs, **options)
    if index.isEmpty():
        return index.withColumn("sha256", F.lit(""))
    back = read(docs.sparkSession, path)
    return index.join(back.select("slot", F.sha2("ids", 256).alias("sha256")), "slot")
