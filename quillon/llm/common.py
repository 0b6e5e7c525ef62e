"""What the operators share: reading tables, stage tables in the shared folder, folds and a vectorised word reader.

A *word* is a maximal run of bytes other than 0x20 and 0x09-0x0D, so ``bytes.split()`` gives exactly the words.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words, as a Java regular expression.
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that one numpy pass takes at a time; a longer text is a pass of its own.
CHUNK_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset: a temporary one in local mode, else an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = spark.conf.get("quillon.scratch.dir", None)
        if not folder:
            folder = tempfile.mkdtemp(prefix="quillon-")
            spark.conf.set("quillon.scratch.dir", folder)
    return folder


#: The folders of stage tables that are still there, by session.
_STAGES: dict[int, list[str]] = {}


def stage_table(spark: SparkSession, df: DataFrame, name: str, done: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor loses nothing.

    The stage tables ``done`` are removed once df is written: nothing else may read them. What is left when the caller
    has used a result goes by ``remove_stage_tables``.
    """
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGES.setdefault(id(spark.sparkContext), []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    for old in done:
        _remove(spark, old.stage_path)
    return out


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    _STAGES[id(spark.sparkContext)].remove(path)


def stage_paths(spark: SparkSession) -> set[str]:
    """The folders of this session's stage tables."""
    return set(_STAGES.get(id(spark.sparkContext), ()))


def remove_stage_tables(spark: SparkSession, keep: set[str] = frozenset()) -> None:
    """Removes this session's stage tables but those of ``keep``. Results that haven't been written or collected can't be read any more."""
    for path in stage_paths(spark) - set(keep):
        _remove(spark, path)


def unused(name: str, columns: list[str]) -> str:
    """A name that no column has, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """array<string> of the words of a text; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


#: Rows of one key that meet its partner in one task, or so.
SPREAD_ROWS = 1000


def hashable(df: DataFrame, columns: list[str] | None = None) -> list[Column]:
    """The columns of df, all or some, in a form that hashes take: those that hold maps as JSON."""
    return [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in df.schema[c].dataType.simpleString() else F.col(f"`{c}`") for c in columns or df.columns]


def spread_join(rows: DataFrame, partners: DataFrame, key: str | list[str], copies: str, by: list[str | Column], total: int | None = None) -> DataFrame:
    """rows joined with the rows of ``partners`` that have their key, however many rows share a key.

    ``copies`` is a column of partners with the number of rows that have the key, and ``total`` their sum. A key of more than SPREAD_ROWS rows is
    dealt over as many salts as it needs, by a hash of the columns ``by``. Such keys are broadcast: the limit rises with the number of rows so that there
    are 100,000 of them at most. The column copies goes.
    """
    if total is None:
        total = partners.agg(F.sum(copies)).first()[0] or 0
    limit = max(SPREAD_ROWS, total // 100_000)
    key = [key] if isinstance(key, str) else key
    salt, salts = unused("salt", [*rows.columns, *partners.columns]), unused("salts", [*rows.columns, *partners.columns])
    pieces = F.ceil(F.col(copies) / limit).cast("int")
    heavy = partners.where(F.col(copies) > limit).select(*key, pieces.alias(salts)).distinct()
    dealt = rows.join(F.broadcast(heavy), key, "left")
    dealt = dealt.withColumn(salt, F.coalesce(F.pmod(F.xxhash64(*by), F.col(salts)).cast("int"), F.lit(0))).drop(salts)
    spread = partners.withColumn(salt, F.explode(F.sequence(F.lit(0), F.greatest(pieces, F.lit(1)) - 1))).drop(copies)
    return dealt.join(spread, [*key, salt]).drop(salt)


# ---- numpy side: runs inside tasks --------------------------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """base**i and base**-i modulo 2**64, for i < n."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(n, b, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordChunk:
    """The words of consecutive texts: byte positions, the first word of each text, and 64-bit hashes on demand."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n" + b"\n".join(texts) + b"\n"
        self.buffer = np.frombuffer(self.data, np.uint8)
        space = _SPACE[self.buffer]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        at = np.cumsum([1] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.starts, at)  # text k has the words first[k] to first[k + 1] - 1

    def hashes(self) -> np.ndarray:
        power, inverse = _power_tables(len(self.buffer))
        total = np.cumsum(_BYTE[self.buffer] * power[: len(self.buffer)])
        return mix((total[self.ends - 1] - total[self.starts - 1]) * inverse[self.starts])


def text_chunks(texts: list[bytes | None]) -> Iterator[tuple[int, int, WordChunk]]:
    """(from, to, words) for runs of texts of CHUNK_BYTES or so; null counts as empty."""
    k = 0
    while k < len(texts):
        size, j = 0, k
        while j < len(texts) and (j == k or size + len(texts[j] or b"") <= CHUNK_BYTES):
            size += len(texts[j] or b"")
            j += 1
        yield k, j, WordChunk([t or b"" for t in texts[k:j]])
        k = j


def as_bytes(column) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()
