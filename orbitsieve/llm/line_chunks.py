"""Removal of repeated multi-line passages by chunks of lines whose ends follow the content.

A chunk opens at every line and ends with the first line at which it has two lines and ``MIN_WORDS`` words;
likewise one ends at every line and opens as late as that allows. Both depend on the chunk's own lines
only, so a passage is cut alike wherever it stands, and these chunks cover every line of every passage of at least
two lines (blank ones count) and ``MIN_WORDS`` words. Chunks that occur again anywhere are compared by their bytes, without
the newline at the end; the first (smallest doc_id, then place) stays and every other one goes, each line
with the newline that ends it. As chunks overlap, a repeated passage goes as a whole, and a line goes if one of its
chunks was there before; the first place of a line's text therefore always stays.

A null or empty text has no chunks and stays as it is. Rows are told apart by id and text; equal rows
lose the same chunks. Rows with a null id stay whole. Other columns pass through.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orbitsieve.llm import text as tx
from orbitsieve.scratch import written

MIN_LINES, MIN_WORDS = 2, 6


def chunks(data: np.ndarray, off: np.ndarray):
    """Of a block: text, start, end (from the text's start), hash of each chunk that counts."""
    feeds = np.flatnonzero(data == 10)
    ends = np.union1d(feeds + 1, off[1:][np.diff(off) > 0])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    if not len(ends):
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]
    sums = tx.prefix_sums(data)
    bare = ends - (data[ends - 1] == 10)  # a line looks alike with and without its newline
    of = np.searchsorted(off, starts, side="right") - 1
    opens, _, _ = tx.word_spans(data, off)
    n, before = len(ends), np.searchsorted(opens, np.append(starts, len(data)))  # words before each line
    line = np.arange(n)
    until = np.maximum(line + MIN_LINES - 1, np.searchsorted(before, before[:-1] + MIN_WORDS) - 1)
    since = np.minimum(line - MIN_LINES + 1, np.searchsorted(before, before[1:] - MIN_WORDS, side="right") - 1)
    first, last = np.concatenate([line, since]), np.concatenate([until, line])
    keep = (first >= 0) & (last < n)
    first, last = first[keep], last[keep]
    first, last = np.divmod(np.unique(first * n + last), n)
    keep = of[first] == of[last]
    first, last = first[keep], last[keep]
    a, b, of = starts[first], ends[last], of[first]
    return of, a - off[of], b - off[of], tx.span_hashes(sums, a, bare[last])


def remove_chunks(docs: DataFrame) -> DataFrame:
    """The input's columns with ``text`` after removal, and n_lines, n_removed_lines, n_removed_chunks (runs of
    removed lines)."""
    tx.small_batches(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("mark")).where(
        F.col("doc_id").isNotNull() & F.col("text").contains("\n")
    )

    def found(batches):
        for batch in batches:
            ids, marks = (batch.column(i).to_numpy() for i in (0, 2))
            for first, _, data, off in tx.blocks(batch.column(1)):
                of, a, b, h = chunks(data, off)
                if len(of):
                    yield pa.record_batch(
                        [pa.array(tx.signed(h)), pa.array(ids[first + of]), pa.array(marks[first + of]), pa.array(a), pa.array(b)],
                        ["hash", "doc_id", "mark", "start", "end"],
                    )

    rows = written(text.mapInArrow(found, "hash long, doc_id long, mark long, start long, end long"), "chunks")
    again = rows.groupBy("hash").count().where("count > 1").select("hash")
    wanted = (
        rows.join(again, "hash").groupBy("doc_id", "mark")
        .agg(F.collect_list(F.struct("hash", "start", "end")).alias("parts"))
    )

    def bytes_of(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            for doc, mark, t, parts in zip(*(c.to_pylist() for c in batch.columns)):
                raw = t.encode()
                for p in parts:
                    for col, x in zip(out, (p["hash"], raw[p["start"] : p["end"]].removesuffix(b"\n"), doc, mark, p["start"], p["end"])):
                        col.append(x)
            kinds = (pa.int64(), pa.binary(), *[pa.int64()] * 4)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], ["hash", "chunk", "doc_id", "mark", "start", "end"])

    parts = written(
        text.join(wanted.hint("merge"), ["doc_id", "mark"]).select("doc_id", "mark", "text", "parts").dropDuplicates(["doc_id", "mark"])
        .mapInArrow(bytes_of, "hash long, chunk binary, doc_id long, mark long, start long, end long"),
        "parts",
    )
    place = F.struct("doc_id", "start", "mark")
    firsts = parts.groupBy("hash", "chunk").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    gone = (
        parts.join(firsts, ["hash", "chunk"]).where(place != F.col("first"))
        .groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_gone"))
        .withColumnsRenamed({"doc_id": "_doc", "mark": "_mark"})
    )
    gone = written(gone, "gone")

    def cut(batches):
        for batch in batches:
            kept, lines, removed, pieces = [], [], [], []
            for t, spans in zip(*(c.to_pylist() for c in batch.columns[-2:])):
                raw, at, out, less, runs = (t or "").encode(), 0, [], 0, 0
                for s in spans or []:
                    if s["end"] <= at:
                        continue
                    start = max(s["start"], at)
                    runs += not less or s["start"] > at
                    out.append(raw[at:start])
                    part = raw[start : s["end"]]
                    less += part.count(b"\n") + (not part.endswith(b"\n"))
                    at = s["end"]
                out.append(raw[at:])
                kept.append(None if t is None else b"".join(out).decode())
                lines.append(raw.count(b"\n") + bool(raw) - raw.endswith(b"\n"))
                removed.append(less)
                pieces.append(runs)
            yield pa.record_batch(
                [*batch.columns[:-2], pa.array(kept, pa.string()), *(pa.array(x, pa.int64()) for x in (lines, removed, pieces))],
                [*batch.schema.names[:-2], "text", "n_lines", "n_removed_lines", "n_removed_chunks"],
            )

    fresh = ("text", "n_lines", "n_removed_lines", "n_removed_chunks")
    own = [c for c in docs.columns if c not in fresh]
    whole = docs.withColumn("_text", F.col("text").cast("string")).join(
        gone.hint("merge"), (F.col("doc_id").cast("long") == F.col("_doc")) & (F.xxhash64("_text") == F.col("_mark")), "left"
    ).select(*own, "_text", "_gone")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema.fields[:-2])
    out = whole.mapInArrow(cut, f"{kinds}, text string, n_lines long, n_removed_lines long, n_removed_chunks long")
    return out.select(*[c for c in docs.columns if c not in fresh[1:]], *fresh[1:])
