"""GeoJSON files read by ranges of bytes, and files digested as streams, in the tasks.

Spark lists the files; tasks open them through Arrow's file systems, which know local paths and the
usual stores. Where Arrow doesn't know a store, files are read whole by Spark's own readers.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE_BYTES = 16 << 20
_BLOCK = 1 << 20
#: States in which a range may begin: outside strings, in one, or in one after a backslash.
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
_COLLECTION = b'"FeatureCollection"'
_REST = re.compile(rb'(?:[^"\\]|\\.)*"', re.DOTALL)
_TOKENS = re.compile(rb'"(?:[^"\\]|\\.)*"|"|[{}\[\]]', re.DOTALL)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a file as Spark names it."""
    scheme = urlsplit(uri).scheme
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(urlsplit(uri).path) if scheme else uri
    return fs.FileSystem.from_uri(uri)


def named(uri: Column) -> Column:
    """A file's name in one form: Spark gives local ones with one slash or with three."""
    return F.regexp_replace(uri, "^file:/+", "file:///")


def known_store(uri: str) -> bool:
    try:
        opened(uri)
    except (pa.ArrowException, OSError, NotImplementedError):
        return False
    return True


def files(spark: SparkSession, path: str, empty: bool = False) -> DataFrame:
    """(uri, length) of the files below a path, without their content; of empty ones too if told so, which Spark lists but doesn't read."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    found = read.select(named(F.col("_metadata.file_path")).alias("uri"), F.col("_metadata.file_size").alias("length"))
    if not empty:
        return found
    listed = spark.createDataFrame([(x,) for x in read.inputFiles()], "uri string").select(named(F.col("uri")).alias("uri"))
    return listed.join(found, "uri", "left").select("uri", F.coalesce("length", F.lit(0).cast("long")).alias("length"))


def _skip(data: bytes, state: int) -> tuple[int, bool]:
    """Where the string ends in which a range begins, and whether it does in the range."""
    if state == OUTSIDE:
        return 0, True
    at = 1 if state == ESCAPED else 0
    met = _REST.match(data, at)
    return (met.end(), True) if met else (len(data), False)


def _left_open(data: bytes, at: int) -> int:
    """The state after a string that is open from `at` to the end."""
    slashes = len(data) - len(data[at:].rstrip(b"\\")) - at
    return ESCAPED if slashes % 2 else INSIDE


def scan(data: bytes, state: int) -> tuple[int, int]:
    """(state at the end, brackets opened less those closed) of a range that begins in a state."""
    at, ended = _skip(data, state)
    if not ended:
        return _left_open(data, 1 if state == ESCAPED else 0) if data else state, 0
    depth = 0
    for met in _TOKENS.finditer(data, at):
        token = met.group()
        if token in (b"{", b"["):
            depth += 1
        elif token in (b"}", b"]"):
            depth -= 1
        elif token == b'"':
            return _left_open(data, met.end()), depth
    return OUTSIDE, depth


def objects(data: bytes, state: int, depth: int, own: int, wanted: int = 2) -> Iterator[tuple[int, int | None]]:
    """(from, to) of objects that open at a depth within the first `own` bytes; to is null where one goes on beyond the data."""
    at, ended = _skip(data, state)
    begin = None
    for met in _TOKENS.finditer(data, at) if ended else ():
        token = met.group()
        if token in (b"{", b"["):
            if begin is None and met.start() >= own:
                return
            if token == b"{" and depth == wanted:
                begin = met.start()
            depth += 1
        elif token in (b"}", b"]"):
            depth -= 1
            if depth == wanted and begin is not None:
                yield begin, met.end()
                begin = None
        elif token == b'"':
            break
    if begin is not None:
        yield begin, None


def _read(uri: str, start: int, size: int) -> bytes:
    store, path = opened(uri)
    with store.open_input_file(path) as file:
        return file.read_at(size, start)


def feature_texts(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(value): each feature of the GeoJSON files below a path as a text; a file that is one feature is one.

    Files are cut into ranges of bytes that different tasks read. A first pass tells of each range how many
    brackets it opens and closes, for each state of strings in which it may begin; put together in order
    these few numbers give the state and depth of every range, and a second pass reads the features that
    begin in each: objects within a list within the collection. Files whose text is no JSON give what can be parsed.
    """
    listed = files(spark, path)
    first = listed.first()
    if first is None or not known_store(first.uri):
        return spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    cuts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    ranges = listed.select("uri", "length", F.explode(cuts).alias("start")).repartition("uri", "start")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for uri, start in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                # What the name of the type begins in this range may end in the next.
                data = _read(uri, start, range_bytes + len(_COLLECTION))
                rows.append((uri, start, *[x for state in (OUTSIDE, INSIDE, ESCAPED) for x in scan(data[:range_bytes], state)], _COLLECTION in data))
            yield pa.RecordBatch.from_pylist([dict(zip(_TOLD.names, r, strict=True)) for r in rows], _TOLD)

    known = ranges.mapInArrow(told, "uri string, start long, s0 int, d0 int, s1 int, d1 int, s2 int, d2 int, collection boolean")
    begins, uri, state, depth, of = [], None, OUTSIDE, 0, {}
    for r in known.orderBy("uri", "start").toLocalIterator():
        if r.uri != uri:
            uri, state, depth = r.uri, OUTSIDE, 0
        begins.append((r.uri, r.start, state, depth))
        of[uri] = of.get(uri, False) or r.collection
        state, depth = r[2 + 2 * state], depth + r[3 + 2 * state]
    begun = spark.createDataFrame([(*b, 2 if of[b[0]] else 0) for b in begins], "uri string, start long, state int, depth int, wanted int").repartition(max(1, min(len(begins), 8 * spark.sparkContext.defaultParallelism)), "uri", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start, state, depth, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data, more = _read(uri, start, range_bytes), range_bytes
                found = list(objects(data, state, depth, range_bytes, wanted))
                while found and found[-1][1] is None and (tail := _read(uri, start + len(data), more)):
                    data, more = data + tail, 2 * more
                    found = list(objects(data, state, depth, range_bytes, wanted))
                texts = [data[s:e].decode("utf-8", "replace") for s, e in found if e is not None]
                yield pa.RecordBatch.from_arrays([pa.array([t for t in texts if wanted == 0 or _is_feature(t)], pa.string())], ["value"])

    return begun.mapInArrow(read, "value string")


_TOLD = pa.schema([("uri", pa.string()), ("start", pa.int64()), *((f"{c}{k}", pa.int32()) for k in range(3) for c in "sd"), ("collection", pa.bool_())])


def _is_feature(text: str) -> bool:
    try:
        return json.loads(text).get("type") == "Feature"
    except ValueError:
        return False


def digests(listed: DataFrame) -> DataFrame:
    """(uri, length, sha256) of files (uri, length), each read as a stream by one task, whatever its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = []
            for uri in b.column(0).to_pylist():
                store, path = opened(uri)
                digest = hashlib.sha256()
                with store.open_input_stream(path) as stream:
                    while block := stream.read(_BLOCK):
                        digest.update(block)
                told.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(told, pa.string())], ["uri", "length", "sha256"])

    return listed.select("uri", "length").mapInArrow(run, "uri string, length long, sha256 string")


__all__ = ["digests", "feature_texts", "files", "known_store", "objects", "opened", "scan"]
