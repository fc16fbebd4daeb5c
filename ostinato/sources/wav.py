"""16-bit WAV as blocks of mono samples, and clips of samples as bytes.

`spark.read.format("pcm_wav")` plans byte ranges of files: the header of a file that is longer than a task's share is read while the plan
is made, and each task seeks to its own blocks. So a recording of any length is read by many tasks, and a block comes whole out of one of
them. Shorter files are dealt out by their length alone, and their headers are read by the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ostinato.operators import signal

CHUNKS = "path string, chunk_no long, rate int, payload binary, error string"
#: Samples of a chunk by default: a minute at 32 kHz.
CHUNK = 32_000 * 60
#: Bytes and files of one task at most, unless one chunk has more.
RANGE_BYTES, RANGE_FILES = 64 << 20, 256
#: Tasks that a smaller share than RANGE_BYTES may make: a task has a cost of its own, so beyond them shares grow, up to RANGE_BYTES.
TASKS = 256
#: Bytes and rows that a task hands on together, unless one chunk has more.
BATCH_BYTES, BATCH_ROWS = 1 << 20, 1 << 12
#: Threads that read headers while a plan is made.
PLANNERS = 32


def header(n_bytes: int, rate: int, channels: int = 1, bits: int = 16) -> bytes:
    """Sizes that 32 bits don't hold are written as all ones: the samples go on to the file's end."""
    import struct

    step = channels * bits // 8
    size = lambda n: min(n, 0xFFFFFFFF)
    return b"RIFF" + struct.pack("<I", size(36 + n_bytes)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * step, step, bits) + b"data" + struct.pack("<I", size(n_bytes))


@dataclass(frozen=True)
class Layout:
    """Where a file's samples are: from byte `start` on, n_frames of `channels` samples each."""

    rate: int
    channels: int
    start: int
    n_frames: int


def layout(file, size: int) -> Layout:
    """Of an open file of so many bytes. Only headers are read; ValueError for what isn't 16-bit WAV. RF64, with sizes of 64 bits, too."""
    import struct

    head = file.read(12)
    if head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, long = 12, None, None
    while at + 8 <= size:
        file.seek(at)
        name, n = struct.unpack("<4sI", file.read(8))
        if name == b"ds64":
            long = struct.unpack("<QQ", file.read(16))[1]
        elif name == b"fmt ":
            form = struct.unpack("<HHIIHH", file.read(16))
        elif name == b"data":
            if form is None or form[5] != 16:
                raise ValueError("16 bits are read only")
            rest = size - at - 8
            n = long if long is not None and n == 0xFFFFFFFF else n
            return Layout(form[2], form[1], at + 8, (rest if n == 0xFFFFFFFF else min(n, rest)) // (2 * form[1]))
        at += 8 + n + n % 2
    raise ValueError("no samples")


def _mono(raw: bytes, channels: int) -> bytes:
    import numpy as np

    if channels == 1:
        return raw
    return np.frombuffer(raw, "<i2").reshape(-1, channels).mean(axis=1).astype("<i2").tobytes()


def decode(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """files (path, content), whole files as values -> a row for each chunk of `chunk` samples; a file that can't be read gives one row
    with its error. A value holds 2 GiB at most: for longer recordings use read_wav."""

    def run(batches):
        import io

        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], map(bytes, pdf["content"])):
                try:
                    found = layout(io.BytesIO(content), len(content))
                except Exception as e:
                    yield pd.DataFrame([(path, None, None, None, str(e))], columns=["path", "chunk_no", "rate", "payload", "error"])
                    continue
                x = _mono(content[found.start : found.start + 2 * found.channels * found.n_frames], found.channels)
                rows = [(path, i // chunk, found.rate, x[2 * i : 2 * (i + chunk)], None) for i in range(0, found.n_frames, chunk)]
                yield pd.DataFrame(rows, columns=["path", "chunk_no", "rate", "payload", "error"])

    return files.select("path", "content").mapInPandas(run, CHUNKS)


@dataclass
class Ranges(InputPartition):
    """What one task reads: (path, its layout or an error, first chunk, the one behind the last); all of a file where only its size is known
    in place of its layout."""

    parts: list[tuple[str, Layout | str | int, int, int]]


class WavReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.chunk = options["path"], int(options.get("chunk", CHUNK))
        self.suffix, self.range_bytes = options.get("suffix", ".wav").lower(), int(options.get("rangebytes", RANGE_BYTES))
        if self.chunk < 1 or self.range_bytes < 1:
            raise ValueError("chunk and rangeBytes must be at least 1")

    def _open(self, path: str):
        fs, base = _filesystem(path)
        return fs.open_input_file(base)

    def _layout(self, path: str, size: int) -> Layout | str:
        try:
            with self._open(path) as f:
                return layout(f, size)
        except Exception as e:
            return str(e)

    def partitions(self) -> list[Ranges]:
        from concurrent.futures import ThreadPoolExecutor

        files = _listed(self.path, self.suffix)
        share = max(self.range_bytes, min(RANGE_BYTES, sum(size for _, size in files) // TASKS))
        out, held, n = [], [], 0
        with ThreadPoolExecutor(PLANNERS) as pool:
            long = pool.map(lambda file: self._layout(*file), [f for f in files if f[1] > share])
            for path, size in files:
                found = next(long) if size > share else size
                chunks = -(-found.n_frames // self.chunk) if isinstance(found, Layout) else 1
                cost = 2 * self.chunk * found.channels if isinstance(found, Layout) else size if size <= share else 1
                at = 0
                while at < chunks:
                    to = min(chunks, at + max(1, (share - n) // max(1, cost)))
                    if held and (n + (to - at) * cost > share or len(held) == RANGE_FILES):
                        out.append(Ranges(held))
                        held, n = [], 0
                        continue
                    held.append((path, found, at, to))
                    n, at = n + (to - at) * cost, to
        return [*out, Ranges(held)] if held else out or [Ranges([])]

    def _rows(self, partition: Ranges):
        """(path, chunk_no, rate, payload, error)"""
        for path, found, first, last in partition.parts:
            if isinstance(found, int):
                found = self._layout(path, found)
                first, last = 0, -(-found.n_frames // self.chunk) if isinstance(found, Layout) else 0
            if isinstance(found, str):
                yield path, None, None, None, found
                continue
            with self._open(path) as f:
                for no in range(first, last):
                    a, b = no * self.chunk, min((no + 1) * self.chunk, found.n_frames)
                    f.seek(found.start + 2 * found.channels * a)
                    yield path, no, found.rate, _mono(f.read(2 * found.channels * (b - a)), found.channels), None

    def read(self, partition: Ranges):
        import pyarrow as pa

        kinds = {"path": pa.string(), "chunk_no": pa.int64(), "rate": pa.int32(), "payload": pa.binary(), "error": pa.string()}
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds.values())], list(kinds))
        held, n = [], 0
        for row in self._rows(partition):
            size = len(row[3] or b"")
            if held and (n + size > BATCH_BYTES or len(held) == BATCH_ROWS):
                yield batch(held)
                held, n = [], 0
            held.append(row)
            n += size
        if held:
            yield batch(held)


class WavSource(DataSource):
    """Options: path (a file or folder, also of a store that pyarrow.fs knows: s3, gs, hdfs), chunk (samples a row), rangeBytes (a task's
    share, which grows where there would be too many tasks), suffix. Files that can't be read have one row with their error."""

    @classmethod
    def name(cls) -> str:
        return "pcm_wav"

    def schema(self) -> str:
        return CHUNKS

    def reader(self, schema) -> WavReader:
        return WavReader(dict(self.options))


def _filesystem(path: str):
    """(file system, path in it)"""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _listed(path: str, suffix: str) -> list[tuple[str, int]]:
    """(path, bytes) of a folder's files by their ending, at any depth, or of one file; in order."""
    from pyarrow import fs

    system, base = _filesystem(path)
    lead = path[: len(path) - len(base)] if path.endswith(base) else "file://" if path.startswith("file:") else ""
    top = system.get_file_info(base)
    if top.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [top] if top.type == fs.FileType.File else system.get_file_info(fs.FileSelector(base, recursive=True))
    return sorted((lead + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(suffix))


def read_wav(spark: SparkSession, path: str, chunk: int = CHUNK, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """CHUNKS of all WAV files below a folder. With a block's samples as `chunk`, each row is a whole block (see signal.padded)."""
    spark.dataSource.register(WavSource)
    return spark.read.format("pcm_wav").option("chunk", chunk).option("rangeBytes", range_bytes).load(path)


def write_wav(files: DataFrame, path: str) -> None:
    """files (name, rate, payload: mono samples in one value, and perhaps lead: bytes before the header) -> a WAV file for each row
    below a folder; a task that runs again writes the same."""
    lead = F.col("lead") if "lead" in files.columns else F.lit(b"")

    def run(batches):
        (fs, top), made = _filesystem(path), set()
        for b in batches:
            for name, rate, payload, before in zip(*[c.to_pylist() for c in b.columns]):
                base = f"{top}/{name}"
                if (folder := base.rpartition("/")[0]) not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                with fs.open_output_stream(base) as f:
                    f.write(before + header(len(payload), rate) + payload)
            yield b.select(["name"])

    files.select("name", "rate", "payload", lead.alias("lead")).mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()


def media_files(spark: SparkSession, path: str, extensions: tuple[str, ...]) -> DataFrame:
    """Files below a folder by their ending; the contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return files.filter(F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1)).isin(*extensions))


def extract_clips(plan: DataFrame, chunks: DataFrame, rate: int) -> DataFrame:
    """plan (source_key, clip_no, start_s, end_s) x chunks of PCM -> (source_key, clip_no, payload): a clip's samples as bytes."""
    first, last = F.round(F.col("start_s") * rate).cast("long"), F.round(F.col("end_s") * rate).cast("long")
    return signal.cut(plan.select("source_key", "clip_no", first.alias("from"), last.alias("to")), chunks, ["clip_no"])
