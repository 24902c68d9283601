"""Model files as a Spark data source: read by many tasks at record offsets, written by as many.

    spark.dataSource.register(ModelSource)
    models.write.format("profile_models").option("path", folder).mode("append").save()
    spark.read.format("profile_models").option("path", folder).load().where("name = 'x'")

A file is binary or text. A binary one is gone through by its headers alone, which say how long a record is; ranges of whole
records become partitions, and those of records that a filter on name or position excludes are never read. Text is cut at
bytes: a record belongs to the range in which it begins. Any store that Arrow's file systems know can be read.

A pressed collection is a Parquet table with the columns of the first filter apart from the rest, so that a scan reads the former
and the latter only for models that something survived.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from seqloom.functions.alphabet import ALPHABETS
from seqloom.operators.profile import configure, quantise_msv
from seqloom.sources import hmmfile, modelforms

SCHEMA = f"file string, position bigint, {hmmfile.SCHEMA}"
#: Columns of hmmfile.SCHEMA, in order.
FIELDS = ("name", "acc", "descr", "m", "max_length", "alphabet", "nseq", "eff_nseq", "checksum", "stats", "cutoffs", "nodes")
#: Bytes of a partition, unless an option names another number.
PART = 4 << 20
#: Bytes that the line at the end of a text record may have.
MARK = 64


def opened(path: str):
    """(file system, path in it) of a path of any known store."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if re.match(r"file:/[^/]", path) else path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of a file, or of a folder's files; those that begin with a dot or an underscore are left out."""
    from pyarrow import fs

    store, root = opened(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root))
    return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and not x.base_name.startswith((".", "_")))


def record_at(f, at: int) -> tuple[str, int]:
    """(name, bytes) of the binary record at a position of an open file, from its header: what is long is stepped over."""
    def take(kind: str, where: int) -> tuple:
        f.seek(where)
        size = struct.calcsize(kind)
        data = f.read(size)
        if len(data) < size:
            raise ValueError("a binary model is cut short")
        return struct.unpack(kind, data)

    def string(where: int) -> tuple[bytes, int]:
        (size,) = take("<i", where)
        f.seek(where + 4)
        return f.read(size)[:-1] if size else b"", where + 4 + size

    magic, flags, m, kind = take("<Iiii", at)
    if magic != modelforms.BINARY:
        raise ValueError("not a binary model of version 3/f")
    has = {name: bool(flags & bit) for name, bit in modelforms.FLAGS.items()}
    letters = len(ALPHABETS[next(a for a, n in modelforms.ALPHABET_NUMBERS.items() if n == kind)])
    now = at + 16 + 4 * (m * letters + (m + 1) * letters + (m + 1) * 7)
    name, now = string(now)
    for field in ("acc", "descr"):
        if has[field]:
            _, now = string(now)
    now += (m + 2) * sum(has[field] for field in ("rf", "mm", "consensus", "cs"))
    _, now = string(now)
    _, now = string(now + 12)
    now += 4 * (m + 1) * has["map"] + 4 + 24 + 24 + 4 * letters * has["compo"]
    return name.decode(), now - at


class Range(InputPartition):
    """Records (position, bytes) of a binary file, or bytes from..to of a text file."""

    def __init__(self, file: str, binary: bool, records: list[tuple[int, int]], low: int = 0, high: int = 0):
        self.file, self.binary, self.records, self.low, self.high = file, binary, records, low, high


class ModelReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.size = options["path"], int(options.get("partbytes", PART))
        self.names: set[str] | None = None
        self.positions: set[int] | None = None

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802 (Spark's name)
        """Takes name = x, name IN (...), position = x and position IN (...); others are Spark's."""
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is not None and f.attribute == ("name",):
                self.names = wanted if self.names is None else self.names & wanted
            elif wanted is not None and f.attribute == ("position",):
                self.positions = wanted if self.positions is None else self.positions & wanted
            else:
                yield f

    def wanted(self, name: str, position: int) -> bool:
        return (self.names is None or name in self.names) and (self.positions is None or position in self.positions)

    def partitions(self) -> list[Range]:
        store = opened(self.path)[0]
        out: list[Range] = []
        for file, size in files_of(self.path):
            with store.open_input_file(file) as f:
                if f.read(4) != struct.pack("<I", modelforms.BINARY):
                    out += [Range(file, False, [], low, min(size, low + self.size)) for low in range(0, size, self.size)]
                    continue
                at, held, total = 0, [], 0
                while at < size:
                    name, length = record_at(f, at)
                    if self.wanted(name, at):
                        held.append((at, length))
                        total += length
                    at += length
                    if held and (total >= self.size or at >= size):
                        out.append(Range(file, True, held))
                        held, total = [], 0
        return out or [Range("", False, [])]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.file:
            return
        with opened(self.path)[0].open_input_file(partition.file) as f:
            if partition.binary:
                for at, length in partition.records:
                    f.seek(at)
                    yield self._row(partition.file, at, modelforms.from_binary(f.read(length))[0])
                return
            for at, text in text_records(f, partition.low, partition.high):
                if self.positions is None or at in self.positions:
                    name = re.search(r"(?m)^NAME\s+(\S+)", text)
                    if self.names is None or (name and name[1] in self.names):  # others aren't parsed
                        yield self._row(partition.file, at, next(modelforms.models_of(text.encode())))

    @staticmethod
    def _row(file: str, at: int, model) -> tuple:
        row = hmmfile.record(model)
        nodes = [tuple(node.values()) for node in row["nodes"]]
        return (file, at, *[nodes if c == "nodes" else row[c] for c in FIELDS])


def text_records(f, low: int, high: int) -> Iterator[tuple[int, str]]:
    """(position, text) of the records that begin in bytes low..high of an open text file: behind the line `//` of the one before, or at the file's beginning. Empty lines in front are left out of the text."""
    at = max(0, low - MARK)
    f.seek(at)
    lines = io.BufferedReader(f, 1 << 16)
    begun = low == 0
    if at:
        at += len(lines.readline())  # a part of a line
    held: list[bytes] = []
    begin = at
    for line in lines:
        if begun and begin >= high:
            return
        at += len(line)
        if begun and (held or line.strip()):
            held.append(line)
        if line[:2] == b"//" and not line[2:].strip():
            if begun:
                yield begin, b"".join(held).decode()
            begun, held, begin = begun or at >= low, [], at
    if held and begin < high:
        raise ValueError("a text model is cut short")


class ModelWriter(DataSourceWriter):
    """One binary file per task; files of tasks that were run twice or failed stay under their temporary names, which readers leave out."""

    def __init__(self, options: dict[str, str]):
        self.path, self.kind = options["path"], options.get("kind", "binary")

    def write(self, iterator) -> WriterCommitMessage:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        name = f"models-{uuid.uuid4().hex}"
        temporary = f"{root}/_{name}"
        with store.open_output_stream(temporary) as f:
            for row in iterator:
                model = hmmfile.from_record(row)
                f.write(modelforms.to_binary(model) if self.kind == "binary" else hmmfile.render(model).encode())
        message = WriterCommitMessage()
        message.files = (temporary, f"{root}/{name}")
        return message

    def commit(self, messages: list) -> None:
        store = opened(self.path)[0]
        for m in messages:
            if m is not None:
                store.move(*m.files)

    def abort(self, messages: list) -> None:
        store = opened(self.path)[0]
        for m in messages:
            if m is not None:
                store.delete_file(m.files[0])


class ModelSource(DataSource):
    """Options: path, a file or folder; partbytes; kind (binary or text) when writing."""

    @classmethod
    def name(cls) -> str:
        return "profile_models"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ModelReader:
        return ModelReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ModelWriter:
        if overwrite:
            raise ValueError("model files are added to a folder; a new folder replaces an old one")
        return ModelWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ModelSource)


# pressed collections
FILTER = "name string, acc string, m int, max_length int, alphabet string, stats map<string,double>, gains binary, bias int"
LATE = ("descr", "nseq", "eff_nseq", "checksum", "cutoffs", "nodes")


def press(models: DataFrame, path: str) -> None:
    """Models (rows of hmmfile.SCHEMA) as a pressed collection: the first filter's integer gains beside the whole model.

    Models come in order of their names within a file, so that a scan for names reads few of a file's stretches.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            costs = [quantise_msv(configure(hmmfile.from_record(row))) for row in pdf.to_dict("records")]
            yield pdf.assign(gains=[c.astype(np.uint8).tobytes() for c, _ in costs], bias=[b for _, b in costs])[order]

    order = [*(c.split(" ")[0] for c in FILTER.split(", ")), *LATE]
    kinds = {f.name: f.dataType for f in T.StructType.fromDDL(f"{hmmfile.SCHEMA}, gains binary, bias int")}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in order])
    models.mapInPandas(run, schema).sortWithinPartitions("name").write.parquet(path)


def filter_parts(spark: SparkSession, path: str) -> DataFrame:
    """What the first filter needs of each model; nothing else of the collection is read."""
    return spark.read.parquet(path).select(*[c.split(" ")[0] for c in FILTER.split(", ")])


def rest_of(spark: SparkSession, path: str, names: DataFrame) -> DataFrame:
    """The whole models of names(name): read late, for survivors of the first filter, as rows of hmmfile.SCHEMA."""
    return spark.read.parquet(path).join(names.select("name").distinct(), "name", "left_semi").select(*FIELDS)
