"""Binary files of graphs and vectors, readable by other tools.

All numbers are little-endian.  A graph starts with tag, version, flags and the
bits of its source and target buckets (u32 each); then for each bucket the
number of its entries (u64) and the entries: source, target (u64), weight (f32)
and 4 bytes of 0.  A vector has bits of one kind, and entries of index, weight
and 4 bytes of 0.  An entry is in the bucket given by the low bits of its ids,
target bits above source bits, in the order of (target, source).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format.
GRAPH_TAG, VECTOR_TAG, VERSION = b"TVGG", b"TVGV", 1
ENTRY = np.dtype([("source", "<u8"), ("target", "<u8"), ("weight", "<f4"), ("zero", "<u4")])
INDEX = np.dtype([("node", "<u8"), ("weight", "<f4"), ("zero", "<u4")])


def _head(tag: bytes, *numbers: int) -> bytes:
    return tag + np.array([VERSION, *numbers], dtype="<u4").tobytes()


def encode_graph(source, target, weight, flags: int = 0, bits: tuple[int, int] = (0, 0)) -> bytes:
    """Bytes of one graph; the entries as stored, so an undirected graph passes both directions."""
    e = np.zeros(len(source), dtype=ENTRY)
    e["source"], e["target"], e["weight"] = source, target, weight
    e = e[np.lexsort((e["source"], e["target"]))]
    low = lambda x, n: (x & np.uint64((1 << n) - 1)).astype(np.int64)
    bucket = (low(e["target"], bits[1]) << bits[0]) | low(e["source"], bits[0])
    out = [_head(GRAPH_TAG, flags, *bits)]
    for b in range(1 << sum(bits)):
        part = e[bucket == b]
        out += [np.uint64(len(part)).tobytes(), part.tobytes()]
    return b"".join(out)


def encode_vector(node, weight, flags: int = 0, bits: int = 0) -> bytes:
    e = np.zeros(len(node), dtype=INDEX)
    e["node"], e["weight"] = node, weight
    e = e[np.argsort(e["node"], kind="stable")]
    bucket = (e["node"] & np.uint64((1 << bits) - 1)).astype(np.int64)
    out = [_head(VECTOR_TAG, flags, bits)]
    for b in range(1 << bits):
        part = e[bucket == b]
        out += [np.uint64(len(part)).tobytes(), part.tobytes()]
    return b"".join(out)


def _buckets(data: bytes, at: int, count: int, kind: np.dtype) -> np.ndarray:
    parts = []
    for _ in range(count):
        if len(data) < at + 8:
            raise ValueError("the file is cut off")
        n = int(np.frombuffer(data, "<u8", 1, at)[0])
        at += 8
        if len(data) < at + n * kind.itemsize:
            raise ValueError("the file is cut off")
        parts.append(np.frombuffer(data, kind, n, at))
        at += n * kind.itemsize
    if at != len(data):
        raise ValueError("the file goes on after its end")
    return np.concatenate(parts)


def decode_graph(data: bytes) -> tuple[np.ndarray, int]:
    """(entries, flags); ValueError for anything but a whole file."""
    if len(data) < 20 or data[:4] != GRAPH_TAG:
        raise ValueError("not a graph, or cut off")
    version, flags, s, t = (int(x) for x in np.frombuffer(data, "<u4", 4, 4))
    if version != VERSION or s + t > 40:
        raise ValueError("no such version")
    return _buckets(data, 20, 1 << (s + t), ENTRY), flags


def decode_vector(data: bytes) -> tuple[np.ndarray, int]:
    if len(data) < 16 or data[:4] != VECTOR_TAG:
        raise ValueError("not a vector, or cut off")
    version, flags, bits = (int(x) for x in np.frombuffer(data, "<u4", 3, 4))
    if version != VERSION or bits > 40:
        raise ValueError("no such version")
    return _buckets(data, 16, 1 << bits, INDEX), flags


def read_graphs(spark: SparkSession, path: str) -> DataFrame:
    """(path, source, target, weight) of binary graph files, each read by one task."""
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b.path, b.content):
                e, _ = decode_graph(bytes(content))
                yield pd.DataFrame({"path": p, "source": e["source"].astype(np.int64), "target": e["target"].astype(np.int64), "weight": e["weight"].astype(float)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "path string, source bigint, target bigint, weight double")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(path, node, weight) of binary vector files."""
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b.path, b.content):
                e, _ = decode_vector(bytes(content))
                yield pd.DataFrame({"path": p, "node": e["node"].astype(np.int64), "weight": e["weight"].astype(float)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "path string, node bigint, weight double")


def _write(df: DataFrame, folder: str, suffix: str, encode) -> None:
    """One file per doc_id, ``<doc_id>.<suffix>``, written by the task that has it; a file that a repeated task writes again is the same."""
    import pyarrow as pa
    from pyarrow import fs

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        store, base = fs.FileSystem.from_uri(folder)
        name, draft = f"{base}/{pdf.doc_id.iloc[0]}.{suffix}", f"{base}/.{pdf.doc_id.iloc[0]}.{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as out:
            out.write(pa.py_buffer(encode(pdf)))
        store.move(draft, name)
        return pd.DataFrame({"n": [1]})

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    df.groupBy("doc_id").applyInPandas(write, "n int").agg({"n": "count"}).collect()  # runs the tasks


def write_graphs(edges: DataFrame, folder: str, flags: int = 0) -> None:
    """A file ``<doc_id>.graph`` for the graph of each document of (doc_id, source, target, weight), which a task must hold."""
    _write(edges.select("doc_id", "source", "target", "weight"), folder, "graph", lambda p: encode_graph(p.source, p.target, p.weight, flags))


def write_vectors(vectors: DataFrame, folder: str, flags: int = 0) -> None:
    """A file ``<doc_id>.vector`` for each vector of (doc_id, node, weight)."""
    _write(vectors.select("doc_id", "node", "weight"), folder, "vector", lambda p: encode_vector(p.node, p.weight, flags))


def id_of(path: str) -> Column:
    """The doc_id of a file written here."""
    return F.regexp_extract(F.col(path), r"([^/]+)\.(?:graph|vector)$", 1).cast("bigint")


def graphs_as_bytes(edges: DataFrame, flags: int = 0) -> DataFrame:
    """(doc_id, content): the binary form of each document's graph, which is small; for ``foreachPartition`` writers."""
    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": [pdf.doc_id.iloc[0]], "content": [encode_graph(pdf.source, pdf.target, pdf.weight, flags)]})

    return edges.select("doc_id", "source", "target", "weight").groupBy("doc_id").applyInPandas(encode, "doc_id bigint, content binary")
