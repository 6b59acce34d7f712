"""Token-ID / binary output.

Documents become flat files of unsigned little-endian ids with 64-bit
document offsets, in ascending document order:

* ``ids-NNNNN.bin``      the part's ids, one after another (2 or 4 bytes each, by vocabulary size)
* ``offsets-NNNNN.bin``  int64, one more than the part has documents; document i is ids[o[i]:o[i + 1]]
* ``docs-NNNNN.bin``     int64 document ids, then one validity byte per document
* ``manifest.json``      per part: counts, and the part's first document and first token

Parts are range partitions by document id, written by the tasks that encode
them; a part's base is the prefix sum of the counts before it (one row per
part reaches the driver, never one per document).  Files appear by rename and
a retried task writes the same bytes.  Readers map the files.

Null text counts as empty: such a document has the end id alone.  Long texts are
encoded whole.  Null ids come first.  Repeated ids keep every row, ordered by text checksum.  An empty
table gives a manifest without parts.  Other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.encoding import encoder
from sluice.llm.shared import filesystem, publish
from sluice.llm.words import blocks

#: Ids read at once for a checksum, and bytes of text encoded at once (a longer text is taken alone).
READ_IDS, ENCODE_BYTES = 1 << 20, 8 << 20

PARTS = "part int, n_docs long, n_tokens long, dtype string"
INDEX = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_token_files(docs: DataFrame, target: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
                      text_col: str = "text") -> list[dict]:
    """Encode every whole text of ``docs`` into ``target`` and return the manifest's parts."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.select("*", F.crc32(F.col("text").cast("binary")).alias("crc"), F.monotonically_increasing_id().alias("pos"))
    keys = [F.col("doc_id").asc_nulls_first(), F.col("crc").asc_nulls_first(), F.col("pos")]
    parts = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        encode = encoder(tokenizer)
        files, path = filesystem(target)
        files.create_dir(path, recursive=True)
        part, mark = first.column(0)[0].as_py(), uuid.uuid4().hex
        tmp = {k: f"{path}/.{k}-{part:05d}-{mark}" for k in ("ids", "offsets", "docs")}
        ends, ids, valid = [np.zeros(1, "<i8")], [], []
        at = 0
        with files.open_output_stream(tmp["ids"]) as out:
            for batch in (part for b in itertools.chain([first], batches) for part in blocks(b, 2, ENCODE_BYTES)):
                raw, counts = encode.closed(batch.column(2), end_id)
                out.write(raw.tobytes())
                ends.append((at + np.cumsum(counts)).astype("<i8"))
                at += len(raw)
                ids.append(batch.column(1).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                valid.append(batch.column(1).is_valid().to_numpy(zero_copy_only=False).astype("u1"))
        with files.open_output_stream(tmp["offsets"]) as out:
            out.write(np.concatenate(ends).tobytes())
        with files.open_output_stream(tmp["docs"]) as out:
            out.write(np.concatenate(ids).tobytes() + np.concatenate(valid).tobytes())
        for kind, temporary in tmp.items():
            publish(files, temporary, f"{path}/{kind}-{part:05d}.bin")
        yield pa.RecordBatch.from_pylist(
            [{"part": part, "n_docs": sum(map(len, ids)), "n_tokens": at, "dtype": encode.dtype.str}],
            pa.schema([("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("dtype", pa.string())]))

    counts = sorted(parts.mapInArrow(write, PARTS).collect())
    first_doc = [0, *itertools.accumulate(c.n_docs for c in counts)]
    first_token = [0, *itertools.accumulate(c.n_tokens for c in counts)]
    manifest = [c.asDict() | {"first_doc": d, "first_token": t} for c, d, t in zip(counts, first_doc, first_token)]
    files, path = filesystem(target)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/manifest.json") as out:
        out.write(json.dumps({"end_id": end_id, "parts": manifest}).encode())
    return manifest


def mapped(files, path: str, dtype) -> np.ndarray:
    """A whole file as an array: memory-mapped where the store is a mounted
    folder, else read."""
    if files.type_name == "local":
        return np.memmap(path, dtype, "r") if files.get_file_info(path).size else np.empty(0, dtype)
    with files.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def crc_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    crc = 0
    for i in range(0, len(ids), READ_IDS):
        crc = zlib.crc32(np.ascontiguousarray(ids[i:i + READ_IDS], "<u4"), crc)
    return crc


def read_token_files(spark: SparkSession, target: str) -> DataFrame:
    """One row per document, read back from the files, one task per part:
    ``doc_id, start`` (ids of all documents before it), ``n_tokens, ids_crc32``."""
    files, path = filesystem(target)
    with files.open_input_file(f"{path}/manifest.json") as f:
        parts = json.loads(f.read())["parts"]
    rows = spark.createDataFrame([(p["part"], p["first_token"], p["dtype"]) for p in parts], "part int, first_token long, dtype string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = filesystem(target)
        for row in (r for b in batches for r in b.to_pylist()):
            name = f"{row['part']:05d}.bin"
            ids = mapped(files, f"{path}/ids-{name}", np.dtype(row["dtype"]))
            offsets = mapped(files, f"{path}/offsets-{name}", "<i8")
            docs = mapped(files, f"{path}/docs-{name}", "u1")
            n = len(offsets) - 1
            doc_ids, valid = docs[:8 * n].view("<i8"), docs[8 * n:].astype(bool)
            for a in range(0, n, 4096):
                z = min(n, a + 4096)
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc_ids[a:z], pa.int64(), mask=~valid[a:z]),
                    pa.array(offsets[a:z] + row["first_token"], pa.int64()),
                    pa.array(np.diff(offsets[a:z + 1]), pa.int64()),
                    pa.array([crc_of(ids[offsets[i]:offsets[i + 1]]) for i in range(a, z)], pa.int64()),
                ], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.repartition(max(1, len(parts))).mapInArrow(read, INDEX)
