"""Documents in flat token files: separators found by a vectorised scan, boundaries stitched by a prefix scan.

A token file is a stream of token identifiers with an end-of-document identifier after each document and no index. It
is stored in blocks that pay no heed to documents, (file, block, tokens), tokens being little-endian integers of two or
four bytes. Each block is scanned on its own; running sums over the blocks of a file then tell where each block stands
and where the last separator before it was, which gives the documents that reach over block ends. The scan over blocks
handles a few numbers a block, and a file's blocks are as many as one writing task made.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches_of, stored

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters given to the tokenizer at once; a longer stretch that the pattern matches as one is given whole.
PIECE = 100_000

_encodings: dict = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """Merge ranks from lines of a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def width_of(ranks: dict[bytes, int], eod: int) -> int:
    """Bytes of a token: 2, or 4 where an identifier goes beyond them."""
    return 2 if max(eod, *ranks.values()) < 1 << 16 else 4


def digest_of(ranks: dict[bytes, int]) -> bytes:
    """What tells a vocabulary from others."""
    out = hashlib.sha256()
    for token, rank in sorted(ranks.items()):
        out.update(b"%d %d " % (len(token), rank) + token)
    return out.digest()


def _encoding(digest: bytes, ranks: dict[bytes, int]):
    """One encoding for a worker process, as long as it gets the same vocabulary."""
    import tiktoken

    if digest not in _encodings:
        _encodings.clear()
        _encodings[digest] = tiktoken.Encoding("lodestone", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[digest]


def write_token_files(docs: DataFrame, ranks: str, eod: int, id_col: str = "doc_id", text_col: str = "text", block: int = 1 << 16, width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Token files of docs, and (file, ordinal, id) of the documents in them: both are written tables.

    A null text is written like an empty one: nothing but its separator. Tokens take width bytes, which width_of gives
    if it is left out; a width too small for the largest identifier is refused.
    """
    spark = docs.sparkSession
    batches_of(spark)
    merges = load_ranks(ranks)
    sent = spark.sparkContext.broadcast((digest_of(merges), merges))  # as large as the vocabulary
    if eod in merges.values():
        raise ValueError("the separator must not be a token's identifier")
    width = width or width_of(merges, eod)
    if width < width_of(merges, eod):
        raise ValueError(f"{width} bytes are too few for the largest identifier")
    kind = {2: "<u2", 4: "<u4"}[width]
    schema = "file int, block int, tokens binary, ids array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, at, held, size, ids = TaskContext.get().partitionId(), 0, [], 0, []
        own = _encoding(*sent.value)

        def out(tokens: np.ndarray):
            nonlocal at, ids
            batch = pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([at], pa.int32()), pa.array([tokens.astype(kind).tobytes()], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], names=["file", "block", "tokens", "ids"])
            at, ids = at + 1, []
            return batch

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = [own.encode_to_numpy(part) for part in _parts(text or "")] if text else []
                held += [*tokens, np.array([eod])]
                size += sum(map(len, tokens)) + 1
                ids.append(doc)
                if size >= block:
                    whole = np.concatenate(held)
                    cuts = range(0, len(whole) - block + 1, block)
                    for i in cuts:
                        yield out(whole[i : i + block])
                    held = [whole[len(cuts) * block :]]
                    size = len(held[0])
        if size or ids:
            yield out(np.concatenate(held))

    written = stored(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema), "tokens")
    ordinal = F.coalesce(F.sum(F.size("ids")).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    named = written.select("file", "block", "ids").withColumn("before", ordinal).select("file", "before", F.posexplode("ids").alias("i", "id")).select("file", (F.col("before") + F.col("i")).alias("ordinal"), "id")
    return written.select("file", "block", "tokens"), named


def _splits(text: str, i: int) -> bool:
    """Whether the pattern ends a match before i and matches both sides alone as it does together.

    So it does where white space begins, and between letters, digits and signs; but an apostrophe may take letters on.
    """
    a, b = text[i - 1], text[i]
    if a.isspace() or b.isspace():
        return b in " \t\n\r" and not a.isspace()
    kinds = [unicodedata.category(c) for c in (a, b)]
    if "Cn" in kinds:  # the tokenizer's tables may be newer and know it as a letter
        return False
    before, behind = (k[0] if k[0] in "LN" else "" for k in kinds)
    return before != behind and not (a == "'" and behind == "L")


def _parts(text: str) -> Iterator[str]:
    """Parts of a text to tokenize alone, cut where the pattern splits too; a stretch without such a place is whole."""
    start = 0
    while len(text) - start > PIECE:
        limit = start + PIECE
        cut = next((i for i in range(limit, start, -1) if _splits(text, i)), None)
        cut = cut or next((i for i in range(limit + 1, len(text)) if _splits(text, i)), len(text))
        yield text[start:cut]
        start = cut
    yield text[start:]


def read_token_files(spark: SparkSession, path: str, width: int = 2, block: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """Blocks (file, block, tokens) of the flat token files below path, in any store that Spark reads, for documents_in,
    and (file, path, size in bytes) of each. A file is nothing but tokens of width bytes, one after the other.

    A file is opened by one task, which cuts it, so that it has to be smaller than 2 GB; blocks then go on alone. A file
    that ends within a token is refused; Spark leaves out empty ones.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    names = found.select("path", F.col("length").alias("size"))
    # one row for each file, without its content
    names = stored(names.select((F.row_number().over(Window.orderBy("path")) - 1).cast("int").alias("file"), "path", "size"), "names")
    broken = names.where(F.col("size") % width != 0).first()
    if broken:
        raise ValueError(f"{broken.path} ends within a token of {width} bytes")
    step = block * width
    number = F.explode(F.sequence(F.lit(0), F.ceil(F.col("length") / step).cast("int") - 1)).alias("block")
    cut = found.where("length > 0").select("path", "content", number)
    blocks = cut.select("path", "block", F.substring("content", F.col("block") * step + 1, F.lit(step)).alias("tokens"))
    return stored(blocks.join(F.broadcast(names.select("file", "path")), "path").select("file", "block", "tokens"), "blocks"), names


def documents_in(files: DataFrame, eod: int, width: int = 2) -> DataFrame:
    """(file, ordinal, start, n_tokens) of every document in files (file, block, tokens), counted from 0.

    n_tokens leaves out the separator; neighbouring separators enclose an empty document. Tokens after a file's last
    separator are a last document, which is how a file without any separator is one document. Empty blocks and files
    hold nothing.
    """
    kind = {2: "<u2", 4: "<u4"}[width]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for tokens in batch.column(2):
                x = np.frombuffer(tokens.as_buffer() or b"", kind)
                found.append(np.nonzero(x == eod)[0].astype(np.int64))
                sizes.append(len(x))
            last = [int(f[-1]) if len(f) else None for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(last, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["file", "block", "size", "last", "found"])

    blocks = stored(files.select("file", "block", "tokens").mapInArrow(scan, "file int, block int, size long, last long, found array<long>"), "separators")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("file", "block", "size", "last", F.size("found").alias("n"), "found")
    carried = carried.withColumn("offset", F.coalesce(F.sum("size").over(earlier), F.lit(0))).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    carried = carried.withColumn("global_last", F.col("offset") + F.col("last")).withColumn("open", F.coalesce(F.max("global_last").over(earlier), F.lit(-1)) + 1)
    ends = carried.where("n > 0").select("file", "before", "offset", "open", F.posexplode(F.arrays_zip("found", F.concat(F.array(F.lit(None).cast("long")), F.slice("found", F.lit(1), F.col("n") - 1)).alias("prior"))).alias("i", "x"))
    start = F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("offset") + F.col("x.prior") + 1)
    closed = ends.select("file", (F.col("before") + F.col("i")).cast("long").alias("ordinal"), start.alias("start"), (F.col("offset") + F.col("x.found") - start).alias("n_tokens"))
    tails = blocks.groupBy("file").agg(F.sum("size").alias("size"), F.sum(F.size("found")).alias("ordinal"))
    reach = carried.groupBy("file").agg(F.max("global_last").alias("global_last"))
    tails = tails.join(reach, "file").withColumn("start", F.coalesce("global_last", F.lit(-1)) + 1)
    return closed.unionByName(tails.where("start < size").select("file", F.col("ordinal").cast("long"), "start", (F.col("size") - F.col("start")).alias("n_tokens")))


def token_counts(docs: DataFrame, ranks: str, eod: int, id_col: str = "doc_id", text_col: str = "text", block: int = 1 << 16) -> DataFrame:
    """(id_col, n_tokens) for every row of docs, counted in the token files written from them.

    Null and empty texts have 0; null ids and repeated rows are returned as they are; an empty table gives an empty one.
    Texts of any length have the count of the whole text; other columns are not used.
    """
    files, named = write_token_files(docs, ranks, eod, id_col, text_col, block)
    found = documents_in(files, eod, width_of(load_ranks(ranks), eod))
    return found.join(named, ["file", "ordinal"]).select(F.col("id").alias(id_col), "n_tokens")
