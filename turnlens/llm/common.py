"""What the operators of this subpackage share: batch helpers, and the engine's scratch tables and places in an order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import numbered
from ..sources.scratch import Scratch, owned, shared_dir

__all__ = ["Scratch", "byte_table", "collected", "held_out", "mapped", "mix64", "most_frequent", "numbered", "owned", "shared_dir", "slices", "table", "unused", "word_count", "word_hashes", "words_of"]

#: White space that separates words, as byte values 0x09 to 0x0D and 0x20.
WHITE_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)
#: Pattern of a word in the contracts that split on that white space.
WORD = r"[^\x20\x09-\x0D]+"


def unused(columns, name: str) -> str:
    """The name, lengthened until none of the columns has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def most_frequent(kept: DataFrame, n: str, most: int) -> DataFrame:
    """Rows of a written table whose count reaches the least bound that leaves ``most`` rows at most. The bound comes from
    how many rows have each count, so no task and no driver sorts the table."""
    held, least = 0, None
    for row in kept.groupBy(n).agg(F.count("*").alias("_rows")).orderBy(F.desc(n)).toLocalIterator():
        held += row["_rows"]
        if held > most:
            break
        least = row[n]
    return kept.where(F.col(n) >= least) if least is not None else kept.limit(0)


def collected(df: DataFrame):
    """A bounded result as a pandas frame, by way of Arrow: neither rows of Python objects nor their pickles are built."""
    out = df.toArrow().to_pandas()
    pa.default_memory_pool().release_unused()
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, modulus: int) -> Column:
    """True where crc32 of the id's decimal text leaves 2; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == 2, F.lit(False))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def byte_table(keep=None, lower: bool = True) -> np.ndarray:
    """A table of 256 bytes for ``mapped``: ASCII capitals to small letters; bytes that ``keep`` refuses to blanks."""
    out = np.arange(256, dtype=np.uint8)
    if lower:
        out[65:91] += 32
    if keep is not None:
        out[[b for b in range(256) if not keep(b)]] = 0x20
    return out


def mapped(texts: pa.Array, with_table: np.ndarray) -> pa.Array:
    """Texts with each UTF-8 byte replaced by the table's; nulls become empty. Lengths in bytes stay."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if texts.offset:
        texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=texts.offset + len(texts) + 1)[texts.offset :]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(with_table[raw])])


def words_of(texts: pa.Array, with_table: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words of the mapped texts in one array, and where each text's words begin (n + 1 offsets)."""
    import pyarrow.compute as pc

    parts = pc.ascii_split_whitespace(mapped(texts, with_table))
    flat, at = parts.flatten(), np.asarray(parts.offsets).astype(np.int64)
    at = at - at[0] if len(at) else np.zeros(1, np.int64)
    full = np.asarray(pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False), dtype=bool)
    before = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)), before[at]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20):
    """Parts of a batch whose texts hold about ``most_bytes``, one text at least; bounds memory whatever the batch holds."""
    import pyarrow.compute as pc

    length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(length):
        if i > start and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(length):
        yield batch.slice(start)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words (the finalizer that splitmix64 uses)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; each distinct word of the batch is hashed once."""
    import xxhash

    coded = flat.dictionary_encode()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    return own[np.asarray(coded.indices)] if len(own) else np.empty(0, np.uint64)
