"""Top-k BM25 over postings grouped by impact, so that a batch of queries reads only what can reach its k best.

A posting's share of a score is idf * (k1 + 1) / (1 + k1 * r) with r = (1 - b + b * dl / avgdl) / tf, which falls with r whatever k1 is. Postings
of a term lie in levels of r, a level in blocks of at most BLOCK postings made where the text index's files are read (so no posting is shuffled, and no term is sorted
or gathered in one task), and every level carries its least r: the greatest share that any of its postings can have.

A search has two passes. The first reads each query's most promising levels, scores the best chunks found exactly and takes the
k-th score as threshold. The second leaves out the words whose greatest shares together stay below the threshold (a chunk with no
other word can't reach it), and of the other words the levels that can't reach it even with all other words' greatest shares; what
it finds is scored exactly if the left-out words could still lift it over the threshold. Frequent words have the
lowest shares, so they make no row for every query and chunk: their postings are looked up for the chunks that are left.

A posting is read once for all queries of a batch and moved once, to its chunk, as numbers; the pairs of a query and a posting are summed where blocks of chunks
meet blocks of queries. Of the levels that are looked up, only postings of chunks that are left are moved, as far as a bitmap of fixed size tells.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.functions.tokenize import Tokenizer, query_tokens, regex_tokens
from lodestone.operators import bm25
from lodestone.operators.bm25 import TextIndex
from lodestone.sources import tables

#: Postings a block, levels an octave of r, postings a query that the first pass reads for each hit wanted, the part of the threshold
#: that left-out words may make up together (more of them: fewer postings read, more chunks scored exactly), and slack for rounded scores.
BLOCK, OCTAVE, HEAD, LEFT_OUT, SLACK = 128, 4, 50, 0.5, 2e-6
#: Pairs of a query and a posting up to which `best` reads them all, which takes fewer jobs; they are summed where they arise and not shuffled.
PAIRS = 100_000_000_000
#: The level of a word's postings where a task has no more than a block of them; postings that a task levels together; log2 of the bits of the bitmap of chunks
#: (4 MB); levels that are broadcast to the blocks (they grow with the queries' words, not with the chunks); rows of numbers in an Arrow batch.
ALL, TOGETHER, BITS, LEVELS, ROWS = -(1 << 15), 1_000_000, 25, 1_000_000, 100_000


def _numbers(spark) -> None:
    """Batches of short rows: bounded by bytes as before."""
    tables.small_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))


class ImpactIndex(NamedTuple):
    """levels(term, level, least, n, df), blocks(term, level, least, n, postings), corpus(n, avgdl, b)."""

    levels: DataFrame
    blocks: DataFrame
    corpus: DataFrame


def _levelled(held: list[pa.RecordBatch], most: int) -> pa.RecordBatch:
    """Rows (term, chunk_id, tf, dl, r) -> (term, level, least, n, postings): runs of a term cut by level into blocks of at most `most`."""
    t = pa.Table.from_batches(held).combine_chunks()
    terms, ids, tf, dl, r = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in t.columns)
    first = bm25.starts(terms)
    word = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(terms)]))
    r = r.to_numpy()
    level = np.where(np.bincount(word)[word] <= most, ALL, np.floor(OCTAVE * np.log2(r))).astype(np.int32)
    order = np.lexsort((level, word))
    word, level, r = word[order], level[order], r[order]
    begin = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (level[1:] != level[:-1])])
    place = np.arange(len(word)) - np.repeat(begin, np.diff(np.r_[begin, len(word)]))
    begin = np.flatnonzero(place % most == 0)
    take = pa.array(order)
    postings = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(word)], pa.int32()), pa.StructArray.from_arrays([ids.take(take), tf.take(take), dl.take(take)], ["chunk_id", "tf", "dl"]))
    cols = [terms.take(pa.array(first[word[begin]])), pa.array(level[begin]), pa.array(np.minimum.reduceat(r, begin)), pa.array(np.diff(np.r_[begin, len(word)]), pa.int64()), postings]
    return pa.RecordBatch.from_arrays(cols, ["term", "level", "least", "n", "postings"])


def _blocked(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size > TOGETHER:
                t = pa.Table.from_batches(held).combine_chunks()
                last = int(bm25.starts(t.column(0).combine_chunks())[-1]) or len(t)  # the last term may go on in the next batch
                yield _levelled(t.slice(0, last).to_batches(), most)
                held = t.slice(last).to_batches()
                size = len(t) - last
        if held:
            yield _levelled(held, most)

    return run


def _levels(blocks: DataFrame) -> DataFrame:
    levels = blocks.groupBy("term", "level").agg(F.min("least").alias("least"), F.sum("n").alias("n"))
    return levels.withColumn("df", F.sum("n").over(Window.partitionBy("term")))


def build(index: TextIndex, b: float = 0.75) -> ImpactIndex:
    """Levels and blocks of a text index, whose postings carry their chunk's length or get it by a join. A task's postings of a term make one level where they are at most BLOCK."""
    _numbers(index.postings.sparkSession)
    corpus = index.corpus.withColumn("b", F.lit(b))
    avgdl = F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0)
    postings = index.postings if "dl" in index.postings.columns else index.postings.join(index.doc_len, "chunk_id")
    r = (1 - F.col("b") + F.col("b") * F.col("dl") / avgdl) / F.col("tf")
    rows = postings.crossJoin(F.broadcast(corpus)).select("term", "chunk_id", F.col("tf").cast("long"), F.col("dl").cast("long"), r.cast("double").alias("r"))  # one row
    posting = types.StructType([types.StructField("chunk_id", index.postings.schema["chunk_id"].dataType), *(types.StructField(c, types.LongType()) for c in ("tf", "dl"))])
    fields = {"term": types.StringType(), "level": types.IntegerType(), "least": types.DoubleType(), "n": types.LongType(), "postings": types.ArrayType(posting)}
    blocks = rows.mapInArrow(_blocked(BLOCK), types.StructType([types.StructField(c, t) for c, t in fields.items()]))
    return ImpactIndex(_levels(blocks), blocks, corpus)


def write(index: ImpactIndex, path: str) -> None:
    """The three tables. Blocks keep the order of the text index's files, levels are sorted by term, so that term filters prune row groups."""
    index.blocks.write.mode("overwrite").parquet(f"{path}/blocks")
    levels = _levels(index.blocks.sparkSession.read.parquet(f"{path}/blocks"))
    levels.repartitionByRange("term").sortWithinPartitions("term", "level").write.mode("overwrite").parquet(f"{path}/levels")
    index.corpus.write.mode("overwrite").parquet(f"{path}/corpus")


def read(spark, path: str) -> ImpactIndex:
    return ImpactIndex(*(spark.read.parquet(f"{path}/{name}") for name in ImpactIndex._fields))


def _idf() -> Column:
    return F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def _slots(ids: pa.Array) -> np.ndarray:
    """The bit of each chunk in a bitmap of BITS."""
    if pa.types.is_integer(ids.type):
        return ids.cast(pa.int64()).to_numpy() & ((1 << BITS) - 1)
    return np.array([zlib.crc32(str(x).encode()) for x in ids.to_pylist()], np.int64) & ((1 << BITS) - 1)


def _bitmap(chunks: DataFrame):
    """Broadcast bitmap of `chunks(chunk_id)`: of fixed size, whatever the chunks."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slots(b.column(0))))], ["slot"])

    words = chunks.mapInArrow(slots, "slot long").groupBy(F.shiftright("slot", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("v")).toArrow()
    bits = np.zeros(1 << (BITS - 6), np.int64)
    bits[words["w"].to_numpy()] = words["v"].to_numpy()
    return chunks.sparkSession.sparkContext.broadcast(bits.view(np.uint8))


def _opened(bitmap=None):
    """Rows (no, postings) -> (chunk_id, no, value) of the postings whose chunk's bit is set; value is tf and dl in one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            p, no = lists.flatten(), b.column(0).to_numpy()[pc.list_parent_indices(lists).to_numpy()]
            ids, tf, dl = (p.field(i) for i in range(3))
            value = tf.to_numpy() << 32 | dl.to_numpy()
            if bitmap is not None:
                slot = _slots(ids)
                kept = np.flatnonzero(bitmap.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                ids, no, value = ids.take(pa.array(kept)), no[kept], value[kept]
            yield pa.RecordBatch.from_arrays([ids, pa.array(no), pa.array(value)], ["chunk_id", "no", "value"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk_id, no, value) in the order of chunks, then no -> blocks of whole chunks: ids, then row, number and value of each row."""

    def block(t: pa.Table) -> pa.RecordBatch:
        ids = t.column(0).combine_chunks()
        ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
        first = bm25.starts(ids)
        row = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(ids)])).astype(np.int64)
        cols = [pa.array([ids.take(pa.array(first)).to_pylist()], pa.list_(ids.type))]
        cols += [pa.array([x.tobytes()], pa.binary()) for x in (row, t.column(1).to_numpy(), t.column(2).to_numpy())]
        return pa.RecordBatch.from_arrays(cols, ["ids", "row", "no", "value"])

    yield from bm25.whole(batches, block)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of asked levels as arrays in the order of (no, q)."""
    for b in batches:
        for a in b.column(0).to_pylist():
            a.sort(key=lambda x: (x["no"], x["q"]))
            cols = [np.array([x[c] for x in a], t) for c, t in (("no", np.int64), ("q", np.int64), ("idf", np.float64), ("least", np.float64))]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in cols], ["a_no", "a_q", "a_idf", "a_least"])


class _Pairs:
    """(q, chunk_id, value) from pairs of a block of chunks and a block of queries. Value: the sum of the shares of the asked levels, as the bits of a double.

    "best": the k greatest sums of a task for every query. "able": all that reach the query's least. "complete": of rows with number -2 - q, which are q's candidates
    with what they have so far as value, the k greatest with the sum added and rounded.
    """

    def __init__(self, mode: str, k: int, k1: float, b: float, avgdl: float, of: pa.DataType):
        self.mode, self.k, self.k1, self.b, self.avgdl, self.of = mode, k, k1, b, avgdl, of

    def pair(self, ids: np.ndarray, rows: list[bytes], asked: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, no, value = (np.frombuffer(x, np.int64) for x in rows)
        a_no, a_q = (np.frombuffer(x, np.int64) for x in asked[:2])
        idf, least = (np.frombuffer(x) for x in asked[2:])
        q_ids, q = np.unique(a_q, return_inverse=True)
        mine = no >= 0
        p_row, p_no, tf, dl = row[mine], no[mine], (value[mine] >> 32).astype(float), (value[mine] & 0xFFFFFFFF).astype(float)
        share = tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / self.avgdl))
        total = np.zeros(len(ids) * len(q_ids))
        lo, hi = np.searchsorted(a_no, p_no, "left"), np.searchsorted(a_no, p_no, "right")
        ends, at = np.cumsum(hi - lo), 0
        while at < len(p_no):  # a posting meets the queries that ask for its level, some PIECE pairs at a time; each chunk's levels stay in order
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + bm25.PIECE, "right")))
            n = hi[at:upto] - lo[at:upto]
            posting = np.repeat(np.arange(at, upto), n)
            asking = np.arange(len(posting)) - np.repeat(np.cumsum(n) - n, n) + lo[posting]
            total += np.bincount(p_row[posting] * len(q_ids) + q[asking], idf[asking] * share[posting], len(total))
            at = upto
        total = total.reshape(len(ids), len(q_ids))
        if self.mode == "complete":
            c_row, c_q, part = row[~mine], -2 - no[~mine], value[~mine].view(float)
            at = np.minimum(np.searchsorted(q_ids, c_q), len(q_ids) - 1)
            own = q_ids[at] == c_q
            c_row, at = c_row[own], at[own]
            return bm25._cut(q_ids[at], ids[c_row], np.round(part[own] + total[c_row, at], 6), self.k)
        limit = np.full(len(q_ids), np.inf)
        np.minimum.at(limit, q, least)
        r, c = np.nonzero((total > 0) & (total >= limit))
        found = q_ids[c], ids[r], total[r, c]
        return bm25._cut(*found, self.k) if self.mode == "best" else found

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for i in range(b.num_rows):
                x = [c[i].as_py() for c in b.columns]
                held.append(self.pair(bm25._array(x[0]), x[1:4], x[4:]))
                size += len(held[-1][0])
                if size > bm25.HELD:
                    if self.mode != "able":
                        held = [bm25._cut(*(np.concatenate(y) for y in zip(*held, strict=True)), self.k)]
                        size = len(held[0][0])
                    if self.mode == "able" or size > bm25.HELD // 2:
                        yield from self.rows(held)
                        held, size = [], 0
        if held:
            yield from self.rows(held if self.mode == "able" else [bm25._cut(*(np.concatenate(y) for y in zip(*held, strict=True)), self.k)])

    def rows(self, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for q, chunk, value in held:
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(chunk, self.of), pa.array(value.view(np.int64))], ["q", "chunk_id", "value"])


def _doubles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(b.column(2).to_numpy().view(float))], ["q", "chunk_id", "score"])


class Search:
    """One batch of `queries(query_id, query)` against an index: what is read, and the k best chunks a query."""

    def __init__(self, index: ImpactIndex, queries: DataFrame, k: int = 20, k1: float = 1.2, stop: list[str] = (), tokenizer: Tokenizer = regex_tokens):
        self.index, self.k, self.k1 = index, k, k1
        words = queries.select("query_id", F.explode(query_tokens(F.col("query"), stop, tokenizer)).alias("term"))
        corpus = F.broadcast(index.corpus.select(F.col("n").alias("docs"), "avgdl", "b"))  # one row
        asked = words.join(index.levels, "term").crossJoin(corpus).withColumn("idf", _idf())
        #: A row for each query, word and level: at most some hundred a word, however many postings it has.
        self.asked = tables.written(asked.select("query_id", "term", "level", "n", "idf", (F.col("idf") * (k1 + 1) / (1 + k1 * F.col("least"))).alias("most")), "asked")
        _numbers(queries.sparkSession)
        self.numbers = tables.written(self.asked.select("term", "level").distinct().withColumn("no", F.monotonically_increasing_id()), "levels")
        self.few = self.numbers.count() <= LEVELS
        self.queries = tables.written(self.asked.select("query_id").distinct().withColumn("q", F.monotonically_increasing_id()), "queries")
        one = index.corpus.first()
        self.one = (one["b"], one["avgdl"]) if one else (0.75, 1.0)
        self.plan = tables.written(self._planned(self._thresholds()), "search-plan")

    def _moved(self, levels: DataFrame, bitmap=None) -> DataFrame:
        """(chunk_id, no, value): the postings of levels (term, level), each once whatever the queries; with a bitmap those of its chunks."""
        wanted = self.numbers.join(levels.select("term", "level").distinct(), ["term", "level"])
        blocks = self.index.blocks.join(F.broadcast(wanted) if self.few else wanted, ["term", "level"]).select("no", "postings")
        return blocks.mapInArrow(_opened(bitmap), types.StructType([self._chunk(), *(types.StructField(c, types.LongType()) for c in ("no", "value"))]))

    def _chunk(self) -> types.StructField:
        return types.StructField("chunk_id", self.index.blocks.schema["postings"].dataType.elementType["chunk_id"].dataType)

    def _paired(self, rows: DataFrame, levels: DataFrame, mode: str, k: int) -> DataFrame:
        """`_Pairs` of rows (chunk_id, no, value) and the queries' levels (query_id, term, level, idf, least)."""
        own = levels.join(self.numbers, ["term", "level"]).join(self.queries, "query_id").select("q", "no", "idf", "least")
        asked = own.unionByName(self.queries.select("q", F.lit(-1).cast("long").alias("no"), F.lit(0.0).alias("idf"), F.lit(float("inf")).alias("least")))  # so that every query has a row
        groups = F.pmod(F.xxhash64("q"), F.lit(1 + self.queries.count() // bm25.QUERIES))
        coded = asked.groupBy(groups).agg(F.collect_list(F.struct("q", "no", "idf", "least")).alias("asked")).select("asked").mapInArrow(_coded, "a_no binary, a_q binary, a_idf binary, a_least binary")
        packed = types.StructType([types.StructField("ids", types.ArrayType(self._chunk().dataType)), *(types.StructField(c, types.BinaryType()) for c in ("row", "no", "value"))])
        dealt = rows.repartition("chunk_id").sortWithinPartitions("chunk_id", "no").mapInArrow(_packed, packed)
        found = types.StructType([types.StructField("q", types.LongType()), self._chunk(), types.StructField("value", types.LongType())])
        pairs = _Pairs(mode, k, self.k1, *self.one, to_arrow_type(self._chunk().dataType))
        return dealt.crossJoin(tables.written(coded, "asked-blocks")).mapInArrow(pairs, found)  # a stated set of queries against the chunks, in blocks

    def _completed(self, candidates: DataFrame, unread: DataFrame) -> DataFrame:
        """(query_id, chunk_id, score, pos): the k best of candidates (q, chunk_id, value) with the shares of the levels (query_id, term, level, idf) that weren't read.

        Of those levels only the postings whose chunk is in the bitmap of the candidates' chunks are moved, each once.
        """
        more = self._moved(unread, _bitmap(candidates.select("chunk_id")))
        rows = more.unionByName(candidates.select("chunk_id", (-2 - F.col("q")).alias("no"), "value"))
        found = self._paired(rows, unread.withColumn("least", F.lit(0.0)), "complete", self.k)
        score = found.mapInArrow(_doubles, types.StructType([types.StructField("q", types.LongType()), self._chunk(), types.StructField("score", types.DoubleType())]))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
        return score.join(self.queries, "q").select("query_id", "chunk_id", "score", F.row_number().over(order).alias("pos")).where(F.col("pos") <= self.k)

    def _words(self) -> DataFrame:
        """(query_id, term, word_most, upto, all_most): each word's greatest share, summed over the words below it and over all."""
        query = Window.partitionBy("query_id")
        upto = query.orderBy("word_most", "term").rowsBetween(Window.unboundedPreceding, 0)
        words = self.asked.groupBy("query_id", "term").agg(F.max("most").alias("word_most"))
        return words.withColumns({"upto": F.sum("word_most").over(upto), "all_most": F.sum("word_most").over(query)})

    def _head(self) -> DataFrame:
        first = Window.partitionBy("query_id").orderBy(F.desc("most"), "term", "level").rowsBetween(Window.unboundedPreceding, -1)
        return self.asked.withColumn("before", F.coalesce(F.sum("n").over(first), F.lit(0))).where(F.col("before") < HEAD * self.k).drop("before")

    def _thresholds(self) -> DataFrame:
        """(query_id, threshold): the k-th best exact score among the chunks of the first pass, less SLACK; none where it finds fewer."""
        head = self._head()
        some = tables.written(self._paired(self._moved(head), head.withColumn("least", F.lit(0.0)), "best", 4 * self.k), "head")
        unread = self.asked.join(head.select("query_id", "term", "level"), ["query_id", "term", "level"], "left_anti")
        kth = self._completed(some, unread).where(F.col("pos") == self.k)
        return kth.select("query_id", (F.col("score") - SLACK).alias("threshold"))

    def _planned(self, thresholds: DataFrame) -> DataFrame:
        """`asked` with read (whether the second pass reads the level), threshold, and rest: the most that unread postings can add to a chunk."""
        rows = self.asked.join(thresholds, "query_id", "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.0))).join(self._words(), ["query_id", "term"])
        left_out = F.col("upto") < LEFT_OUT * F.col("threshold")
        too_low = F.col("most") + F.col("all_most") - F.col("word_most") < F.col("threshold")
        rows = rows.withColumn("read", ~left_out & ~too_low)
        missed = rows.where("NOT read").groupBy("query_id", "term").agg(F.max("most").alias("m")).groupBy("query_id").agg(F.sum("m").alias("rest"))
        return rows.select("query_id", "term", "level", "n", "idf", "threshold", "read").join(missed, "query_id", "left").withColumn("rest", F.coalesce("rest", F.lit(0.0)))

    def reading(self) -> DataFrame:
        """(query_id, postings, read): the postings of each query's words, and how many both passes read."""
        head = self._head().select("query_id", "term", "level", F.lit(True).alias("head"))
        rows = self.plan.join(head, ["query_id", "term", "level"], "left")
        return rows.groupBy("query_id").agg(F.sum("n").alias("postings"), (F.sum(F.when(F.col("read"), F.col("n")).otherwise(0)) + F.sum(F.when(F.col("head"), F.col("n")).otherwise(0))).alias("read"))

    def hits(self) -> DataFrame:
        """(query_id, chunk_id, score, pos): the k best chunks a query by (score, chunk_id), as the exhaustive search gives them."""
        read = self.plan.where("read")
        able = tables.written(self._paired(self._moved(read), read.withColumn("least", F.col("threshold") - F.col("rest")), "able", self.k), "able")
        return self._completed(able, self.plan.where("NOT read"))


def search(index: ImpactIndex, queries: DataFrame, k: int = 20, k1: float = 1.2, stop: list[str] = (), tokenizer: Tokenizer = regex_tokens) -> DataFrame:
    """`bm25.search` with pruning: same rows, same scores."""
    return Search(index, queries, k, k1, stop, tokenizer).hits()


def best(exhaustive: TextIndex, impacts: Callable[[], ImpactIndex], queries: DataFrame, k: int = 20, k1: float = 1.2) -> DataFrame:
    """The same hits by the cheaper way: all postings where the batch has few pairs of a query and a posting, else those that matter."""
    words = queries.select("query_id", F.explode(query_tokens(F.col("query"))).alias("term"))
    pairs = words.join(exhaustive.term_stats, "term").agg(F.sum("df")).first()[0] or 0
    return search(impacts(), queries, k, k1) if pairs > PAIRS else bm25.search(exhaustive, queries, k, k1)
