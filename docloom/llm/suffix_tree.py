"""Language model scores from a probabilistic suffix tree.

The states of the tree are contexts of up to two words. A context seen often enough becomes a state if its
next-symbol distribution departs from that of its longest shorter state by more than its size costs, and it stores
the transitions that do so by themselves. Distributions
are discounted and filled up from the shorter state, down to the smoothed counts of single tokens, so each sums to
one. A token is scored in the longest state that its preceding words end in.

Every word that occurs TRANSITION times in the rows learned from is a symbol, since no other can stand in a state or a
stored transition; others are scored by their own exact counts. Symbols are numbered by falling count, so that the counts
of all of them are a short table of steps. The first NEAR of them lie on every task, the others are found by a join.
Counts, states and transitions are tables that grow with the corpus.
The most frequent states and transitions, HEAD of each kind at most, and filters of fixed size over the others lie on
every task; tokens that these can't settle are joined with the tables.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import salted_join, utf8
from docloom.plans.scans import bucketed_row_number
from docloom.plans.stage import cut

HELD = 10
ADD = 0.1
NEAR = 1 << 18
WORD_BYTES = 64  # a word that lies on every task is no longer than this
BITS = 31
CONTEXT = 64  # least occurrences of a context
TRANSITION = 2  # least occurrences of a stored transition
DISCOUNT = 0.5
COST = 12.0  # nats that a state must gain for itself and for each of its transitions
HEAD = 1 << 22
FILTER = 1 << 25
CHUNK = 1 << 19  # symbols that a task holds while it counts what follows them
OUT = 1 << 16  # rows of a batch of counts
WORDS = 400_000  # distinct words that a task counts at a time
BUCKETS = 1024
MASK = (1 << BITS) - 1
END = b""


def held_out(doc_id: bytes) -> bool:
    return zlib.crc32(doc_id) % HELD == 0


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct tokens, the number among them of every token of all texts, and the tokens of each text.

    Tokens stand between ASCII white space, A-Z in lower case; each text has the empty token behind, its end.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    lists = pc.ascii_split_whitespace(trimmed)
    flat, many = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.binary_length(trimmed).to_numpy(zero_copy_only=False) == 0
    if empty.any():  # an empty text splits into one empty word
        many = np.where(empty, 0, many)
        flat = flat.filter(pc.greater(pc.binary_length(flat), 0))
    coded = flat.dictionary_encode()
    many = many + 1
    codes = np.full(int(many.sum()), len(coded.dictionary), np.int64)
    inner = np.ones(len(codes), bool)
    inner[np.cumsum(many) - 1] = False
    codes[inner] = coded.indices.to_numpy(zero_copy_only=False)
    return pa.concat_arrays([coded.dictionary, pa.array([""], pa.string())]), codes, many


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, n, c): occurrences in all rows and in the rows learned from. The end is the empty token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        count = 0

        def merge() -> None:
            nonlocal count
            coded = pa.concat_arrays([h[0] for h in held]).dictionary_encode()
            at, size = coded.indices.to_numpy(), len(coded.dictionary)
            n, c = (np.bincount(at, np.concatenate([h[k] for h in held]), size).astype(np.int64) for k in (1, 2))
            held[:] = [(coded.dictionary, n, c)]
            count = size

        def flush() -> pa.RecordBatch:
            merge()
            (tokens, n, c), held[:] = held[0], []
            return pa.RecordBatch.from_arrays([tokens, pa.array(n), pa.array(c)], ["token", "n", "c"])

        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, codes, many = words_of(batch.column("text"))
            learned = np.repeat(np.array([not held_out(k) for k in utf8(batch, "doc_id")]), many)
            held.append((tokens, np.bincount(codes, minlength=len(tokens)), np.bincount(codes[learned], minlength=len(tokens))))
            count += len(tokens)
            if count > 3 * WORDS:
                merge()
                if count > WORDS:
                    yield flush()
                    count = 0
        if held:
            yield flush()

    counted = docs.mapInArrow(run, "token string, n bigint, c bigint")
    return counted.groupBy("token").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


@dataclass
class Alphabet:
    """Symbols are numbered by falling count in training: steps of equal counts, and the words that lie on every task."""

    tokens: pa.Array
    numbers: np.ndarray  # the symbols of `tokens`
    starts: np.ndarray  # the first symbol of each count
    counts: np.ndarray  # the counts, falling
    size: int
    total: int
    distinct: int

    @property
    def whole(self) -> bool:
        """Whether every symbol lies on every task."""
        return len(self.tokens) == self.size

    def at_least(self, least: int) -> int:
        """How many symbols, the first ones, have such a count."""
        fit = np.flatnonzero(self.counts < least)
        return int(self.starts[fit[0]]) if len(fit) else self.size

    def counts_of(self, symbols: np.ndarray) -> np.ndarray:
        return self.counts[np.searchsorted(self.starts, symbols, side="right") - 1] if len(symbols) else np.zeros(0, np.int64)

    def first(self, most: int = NEAR) -> np.ndarray:
        """The log10 probabilities of the first symbols by their counts."""
        return self.root(np.arange(min(most, self.size)))

    def root(self, symbols: np.ndarray) -> np.ndarray:
        return np.log10((self.counts_of(symbols) + ADD) / (self.total + ADD * (self.distinct + 1)))

    def roots(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The log10 probability of each token by its count, zero for those that are no symbols. `first` is made by first()."""
        out = np.zeros(len(ids))
        near = np.flatnonzero((ids >= 0) & (ids < len(first)))
        out[near] = first[ids[near]]
        late = np.flatnonzero(ids >= len(first))
        out[late] = self.root(ids[late])
        return out


def numbered(counted: DataFrame, size: int | None, near: int, least: int) -> tuple[DataFrame, Alphabet]:
    """The counts with the symbol of each token that is one: those with the count `least`; of these the `size` most frequent short ones, if a size is given."""
    total, distinct = counted.select(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    letters, other = counted.where(F.col("c") >= max(1, least)), counted.where(F.col("c") < max(1, least))
    if size is not None:
        letters = cut(counted.where(F.octet_length("token") <= WORD_BYTES).orderBy(F.desc("n"), "token").limit(size)).where(F.col("c") >= max(1, least))
        other = counted.join(letters.select("token"), "token", "left_anti")
    steps = letters.groupBy("c").count().toArrow().sort_by([("c", "descending")])  # counts that differ: few, since they add up to all tokens
    counts, many = steps.column("c").to_numpy().astype(np.int64), steps.column("count").to_numpy().astype(np.int64)
    starts = np.cumsum(many) - many
    begin = counted.sparkSession.createDataFrame(list(zip(counts.tolist(), starts.tolist(), strict=True)), "c bigint, begin bigint")
    placed = bucketed_row_number(letters.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(BUCKETS))), ["c"], "bucket", [F.col("token")])
    placed = placed.join(F.broadcast(begin), "c").select("token", "n", "c", (F.col("begin") + F.col("rn") - 1).alias("symbol"))
    out = cut(placed.unionByName(other.select("token", "n", "c", F.lit(None).cast("bigint").alias("symbol"))))
    held = out.where((F.col("symbol") < near) & (F.octet_length("token") <= WORD_BYTES)).select("token", "symbol").toArrow()
    tokens = held.column("token").cast(pa.string()).combine_chunks()
    return out, Alphabet(tokens, held.column("symbol").to_numpy().astype(np.int64), starts, counts, int(many.sum()), total, distinct)


@dataclass
class Corpus:
    """Documents as lists of symbols, with the counts of all tokens they were made by.

    rows: row, doc_id, held_out, ids (the symbol of every token, negative where it is none); rare: row, rare_lp and rare_known,
    sums over the tokens of a row that are no symbols.
    """

    vocabulary: DataFrame
    symbols: Alphabet
    rows: DataFrame
    rare: DataFrame


ENCODED = "row bigint, doc_id bigint, held_out boolean, ids array<int>, rare array<struct<token:string,n:bigint>>"


def encode(docs: DataFrame, size: int | None = None, like: Corpus | None = None, near: int = NEAR, least: int = TRANSITION) -> Corpus:
    """The corpus of (doc_id, text); by the counts and the symbols of another corpus, if one is given.

    Words of at least `least` occurrences in training are symbols; with a size, only the most frequent ones of them.
    """
    if like is None:
        vocabulary, symbols = numbered(cut(token_counts(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"))), size, near, least)
    else:
        vocabulary, symbols = like.vocabulary, like.symbols
    shared = docs.sparkSession.sparkContext.broadcast(symbols)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("id"), F.col("doc_id").cast("string").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, codes, many = words_of(batch.column("text"))
            place = pc.index_in(tokens, value_set=known.tokens).fill_null(-1).to_numpy()
            symbol = np.where(place >= 0, known.numbers[place], -1) if len(known.numbers) else np.full(len(tokens), -1)
            ids = symbol[codes].astype(np.int32)
            # a token that is not at hand is -2 - its place in the list of such tokens of its row
            at = np.flatnonzero(ids < 0)
            row = np.repeat(np.arange(len(many)), many)[at]
            key, inverse, n = np.unique(row << 32 | codes[at], return_inverse=True, return_counts=True)
            ends = np.searchsorted(key, np.arange(len(many) + 1) << 32)
            ids[at] = -2 - (inverse - ends[row])
            some = pa.StructArray.from_arrays([tokens.take(pa.array(key & 0xFFFFFFFF)), pa.array(n, pa.int64())], ["token", "n"])
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), batch.column("id"), pa.array([held_out(k) for k in utf8(batch, "doc_id")]),
                pa.ListArray.from_arrays(pa.array(np.cumsum([0, *many]), pa.int32()), pa.array(ids)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), some),
            ], ["row", "doc_id", "held_out", "ids", "rare"])

    encoded = cut(rows.mapInArrow(run, ENCODED), "zstd")
    rare = encoded.select("row", F.posexplode("rare").alias("k", "r")).select("row", "k", "r.token", F.col("r.n").alias("times"))
    met = salted_join(rare, vocabulary, ["token"], "n", ["row"], symbols.total)
    c, none = F.coalesce("c", F.lit(0)), F.col("symbol").isNull()
    lp = F.log10((c + ADD) / F.lit(symbols.total + ADD * (symbols.distinct + 1)))
    sums = [F.sum(F.when(none, lp * F.col("times"))).alias("rare_lp"), F.sum(F.when(none & (c > 0), F.col("times")).otherwise(0)).alias("rare_known")]
    if symbols.whole:
        return Corpus(vocabulary, symbols, encoded.drop("rare"), met.groupBy("row").agg(*sums))
    found = F.collect_list(F.when(~none, F.struct("k", F.col("symbol").cast("int").alias("symbol")))).alias("found")
    sums = cut(met.groupBy("row").agg(*sums, found))
    slim = encoded.select("row", "doc_id", "held_out", "ids", F.size("rare").alias("many")).join(sums.select("row", "found"), "row", "left")
    filled = slim.mapInArrow(_filled, "row bigint, doc_id bigint, held_out boolean, ids array<int>")
    return Corpus(vocabulary, symbols, cut(filled, "zstd"), sums.drop("found"))


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The symbols that were found by a join put where their tokens stand."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists, found = batch.column("ids"), batch.column("found")
        ids, size = lists.flatten().to_numpy().copy(), lists.value_lengths().to_numpy()
        many = batch.column("many").to_numpy().astype(np.int64)
        before = np.cumsum(many) - many
        symbol = np.full(int(many.sum()), -1, np.int32)
        each, flat = found.value_lengths().fill_null(0).to_numpy(), found.flatten()
        symbol[np.repeat(before, each) + flat.field("k").to_numpy()] = flat.field("symbol").to_numpy()
        at = np.flatnonzero(ids < -1)
        ids[at] = symbol[np.repeat(before, size)[at] - 2 - ids[at]]
        yield pa.RecordBatch.from_arrays([
            batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *size]), pa.int32()), pa.array(ids))
        ], ["row", "doc_id", "held_out", "ids"])


def _symbols_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all rows of a batch, -1 where there is none, and where each row begins; every row has at least its end."""
    lists = batch.column("ids")
    return np.maximum(lists.flatten().to_numpy().astype(np.int64), -1), np.cumsum([0, *lists.value_lengths().to_pylist()])[:-1]


def contexts(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols one and two places before each token; -1 where there is none, behind an unknown word or across documents."""
    one, two = np.full(len(ids), -1, np.int64), np.full(len(ids), -1, np.int64)
    one[1:], two[2:] = ids[:-1], ids[:-2]
    one[first] = two[first] = -1
    second = first[first + 1 < len(ids)] + 1
    two[second] = -1
    two[one < 0] = -1
    return one, two


def followers(batches: Iterator[pa.RecordBatch], depth: int, limit: int, keep: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Counts of symbols behind their contexts: (key, n) with both in one number, or (context, x, n) for contexts of two words.

    About CHUNK symbols are held at a time, and counts are passed on in short batches: both sides of a worker's pipe hold whole batches.
    """
    context, x, held = np.empty(CHUNK, np.int64), np.empty(CHUNK, np.int64), 0

    def flush() -> Iterator[pa.RecordBatch]:
        key, last = context[:held], x[:held]
        if depth == 1:
            key, n = np.unique(key << BITS | last, return_counts=True)
            columns = {"key": key, "n": n}
        else:
            own, place = np.unique(key, return_inverse=True)
            pair, n = np.unique(place << BITS | last, return_counts=True)
            columns = {"context": own[pair >> BITS], "x": pair & MASK, "n": n}
        for at in range(0, len(columns["n"]), OUT):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + OUT], pa.int64()) for c in columns.values()], list(columns))

    for batch in batches:
        ids, first = _symbols_of(batch)
        one, two = contexts(ids, first)
        fit = (ids >= 0) & (one >= 0) & (one < limit)
        fit = np.flatnonzero(fit if depth == 1 else fit & (two >= 0) & (two < limit))
        own = one[fit] if depth == 1 else two[fit] << BITS | one[fit]
        if keep is not None:
            good = passes(keep, own)
            own, fit = own[good], fit[good]
        at = 0
        while at < len(own):
            take = min(len(own) - at, len(context) - held)
            context[held : held + take], x[held : held + take] = own[at : at + take], ids[fit[at : at + take]]
            at, held = at + take, held + take
            if held == len(context):
                yield from flush()
                held = 0
    if held:
        yield from flush()


def _counted(corpus: Corpus, depth: int, limit: int, wanted=None) -> DataFrame:
    """(context, x, n): how often symbol x follows a context of symbols below `limit` in the training rows; contexts that `wanted` rejects are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return followers(batches, depth, limit, wanted.value if wanted else None)

    rows = corpus.rows.where(~F.col("held_out")).select("ids")
    if depth == 2:
        return rows.mapInArrow(run, "context bigint, x bigint, n bigint").groupBy("context", "x").agg(F.sum("n").alias("n"))
    pairs = rows.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    return pairs.select(F.shiftright("key", BITS).alias("context"), F.col("key").bitwiseAND(MASK).alias("x"), "n")


def _pair(context: str, x: str) -> Column:
    return F.shiftleft(F.col(context).cast("bigint"), BITS).bitwiseOR(F.col(x).cast("bigint"))


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - int(math.log2(FILTER)))).astype(np.int64)


def _mixed(context: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A number for the filter; equal for equal contexts and symbols."""
    mixed = (context.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (x.astype(np.uint64) * np.uint64(0x165667B19E3779F9))
    return (mixed ^ mixed >> np.uint64(29)).astype(np.int64)


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the set that the bits were set for; all that are do."""
    at = _slot(keys)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def key_filter(keys: DataFrame) -> np.ndarray:
    """One bit for each hash of a bigint column, or of a context and a symbol: FILTER / 8 bytes whatever the number of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER // 8, np.uint8)
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            at = _slot(columns[0] if len(columns) == 1 else _mixed(*columns))
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        at = np.flatnonzero(words := bits.view(np.int64))
        for k in range(0, len(at), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 65_536], pa.int32()), pa.array(words[at[k : k + 65_536]])], ["at", "word"])

    merged = keys.mapInArrow(run, "at int, word bigint").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    bits = np.zeros(FILTER // 64, np.int64)
    bits[merged.column("at").to_numpy()] = merged.column("word").to_numpy()
    return bits.view(np.uint8)


def _states(rows: DataFrame, cost: float) -> tuple[DataFrame, DataFrame]:
    """States and their transitions out of (context, x, size, n, parent): `parent` is the probability in the shorter state.

    states: context, size, bow (log10 of what the shorter state's probabilities are multiplied by) and m transitions;
    transitions: context, x, n, lp (log10).
    """
    share = (F.col("n") - DISCOUNT) / F.col("size")
    rows = rows.where(F.col("n") * F.ln(share / F.col("parent")) > cost)
    kept = rows.groupBy("context").agg(F.sum(share).alias("mass"))
    rows = rows.join(kept, "context").withColumn("p", share + (1 - F.col("mass")) * F.col("parent"))
    gain = rows.groupBy("context").agg(
        F.sum(F.col("n") * F.ln(F.col("p") / F.col("parent"))).alias("gain"), F.sum("n").alias("seen"), F.count("*").alias("m"), F.max("size").alias("size"), F.max("mass").alias("mass")
    )
    left = F.ln(1 - F.col("mass"))
    states = gain.where(F.col("gain") + (F.col("size") - F.col("seen")) * left > cost * (1 + F.col("m"))).select("context", "size", F.log10(1 - F.col("mass")).alias("bow"))
    states = cut(states)
    return states, cut(rows.join(states.select("context"), "context").select("context", "x", "n", F.log10("p").alias("lp")))


@dataclass
class Tree:
    symbols: Alphabet
    states: dict[int, DataFrame]
    transitions: dict[int, DataFrame]
    limit: int  # symbols below it are frequent enough to stand in contexts
    bow1: np.ndarray  # log10 factor of the first symbols, NaN for those that are no states
    head: dict[str, np.ndarray]
    whole: bool  # every state is in the head


def _with_parents(counted: DataFrame, symbols, bow1) -> DataFrame:
    """The word before, its size and the pair with the last symbol of every counted context, and the probability of the
    last symbol by its count, and in the state of the word before it, if that is in `bow1`, without that word's own transitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bow = symbols.value, np.append(bow1.value, np.nan)
        first = known.first()
        for batch in batches:
            context, x = batch.column("context").to_numpy(), batch.column("x").to_numpy()
            one = context & MASK
            root = 10 ** known.roots(x, first)
            below = root * 10 ** np.nan_to_num(bow[np.minimum(one, len(bow) - 1)])
            arrays = [context, x, batch.column("n").to_numpy(), one, one << BITS | x, known.counts_of(one), root, below]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["context", "x", "n", "one", "pair", "size", "root", "below"])

    return counted.mapInArrow(run, "context bigint, x bigint, n bigint, one bigint, pair bigint, size bigint, root double, below double")


def learn(corpus: Corpus, least: int = CONTEXT, transition: int = TRANSITION, cost: float = COST, head: int = HEAD) -> Tree:
    """The tree of the rows that are not held out."""
    symbols, context = corpus.symbols, corpus.rows.sparkSession.sparkContext
    limit = symbols.at_least(least)
    shared, bow1 = context.broadcast(symbols), np.full(min(limit, head), np.nan)

    pairs = cut(_counted(corpus, 1, limit).where(F.col("n") >= transition), "zstd")
    first = _with_parents(pairs, shared, context.broadcast(bow1)).select("context", "x", "size", "n", F.col("root").alias("parent"))
    states1, transitions1 = _states(first, cost)
    found = states1.where(F.col("context") < len(bow1)).select("context", "bow").toArrow()  # at most one row per symbol of the head
    bow1[found.column("context").to_numpy()] = found.column("bow").to_numpy()

    # contexts of two words: the pairs that are frequent enough themselves
    longer = pairs.where((F.col("n") >= least) & (F.col("x") < limit)).select(_pair("context", "x").alias("context"), F.col("n").alias("size"))
    triples = cut(_counted(corpus, 2, limit, context.broadcast(key_filter(longer.select("context")))).where(F.col("n") >= transition), "zstd")
    second = _with_parents(triples, shared, context.broadcast(bow1)).drop("size").join(longer, "context")
    if limit > len(bow1):
        far = states1.where(F.col("context") >= len(bow1)).select(F.col("context").alias("one"), F.col("bow").alias("far"))
        second = second.join(far, "one", "left").withColumn("below", F.col("below") * F.pow(F.lit(10.0), F.coalesce("far", F.lit(0.0))))
    second = second.join(transitions1.select(_pair("context", "x").alias("pair"), F.col("lp").alias("lp1")), "pair", "left")
    parent = F.coalesce(F.pow(F.lit(10.0), "lp1"), F.col("below"))
    states2, transitions2 = _states(second.select("context", "x", "size", "n", parent.alias("parent")), cost)
    tree = Tree(symbols, {1: states1, 2: states2}, {1: transitions1, 2: transitions2}, limit, bow1, {}, False)
    _fill_head(tree, head)
    return tree


def _top(rows: DataFrame, measure: str, most: int) -> tuple[DataFrame, DataFrame]:
    """The rows of largest measure, whole grades of it and `most` rows at most, and the others."""
    grade = F.floor(F.log2(measure) * 8)
    held, least = 0, None
    for row in sorted(rows.groupBy(grade.alias("grade")).count().collect(), key=lambda r: -r["grade"]):  # a few hundred grades at most
        held += row["count"]
        if held > most:
            break
        least = row["grade"]
    top = F.lit(False) if least is None else grade >= int(least)
    return rows.where(top), rows.where(~top)


def _fill_head(tree: Tree, most: int) -> None:
    """The most frequent long states and transitions, `most` of each table at most, and filters of fixed size over the others.

    A long transition has the place of its state in the head for its context; those of other states are not asked for there.
    """
    out: dict[str, np.ndarray] = {}
    for name, rows, keys, value, measure in (
        ("state", tree.states[2], ["context"], "bow", "size"), ("move1", tree.transitions[1], ["context", "x"], "lp", "n"), ("move2", tree.transitions[2], ["context", "x"], "lp", "n"),
    ):
        top, rest = _top(rows, measure, most)
        if name != "state":
            top = _packed(top, value, rows.sparkSession.sparkContext.broadcast(out["state"]) if name == "move2" else None)
        found = cut(top.select(F.col(top.columns[0]).alias("key"), F.col(value).cast("float").alias("value"))).toArrow().sort_by("key")
        out[name], out[name + "_value"] = (found.column(k).to_numpy() for k in ("key", "value"))
        asked = rest.select(_pair("context", "x").alias("key")) if name == "move1" else rest.select(*keys)
        out[name + "_filter"] = np.zeros(0, np.uint8) if rest.isEmpty() else key_filter(asked)
    tree.head, tree.whole = out, tree.limit == len(tree.bow1) and not any(len(out[f"{name}_filter"]) for name in ("state", "move1", "move2"))


def _packed(moves: DataFrame, value: str, states=None) -> DataFrame:
    """(key, value) of transitions: context and symbol in one number; with `states`, the place of the context among them, and no others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            context = batch.column("context").to_numpy()
            place = context if states is None else found_in(states.value, context)
            known = np.flatnonzero(place >= 0)
            yield pa.RecordBatch.from_arrays([pa.array((place << BITS | batch.column("x").to_numpy())[known]), batch.column(value).take(pa.array(known))], ["key", value])

    return moves.select("context", "x", value).mapInArrow(run, f"key bigint, {value} double")


def found_in(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The place of every key asked for among sorted ones, -1 where there is none. Sorted questions find neighbours in memory."""
    if not len(keys) or not len(asked):
        return np.full(len(asked), -1, np.int64)
    order = np.argsort(asked)
    ranked = asked[order]
    at = np.minimum(np.searchsorted(keys, ranked), len(keys) - 1)
    out = np.empty(len(asked), np.int64)
    out[order] = np.where(keys[at] == ranked, at, -1)
    return out


def _looked_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The value of every key, NaN where there is none."""
    at = found_in(keys, asked)
    return np.where(at >= 0, values[at], np.nan) if len(keys) else np.full(len(asked), np.nan)


def settle(head: dict[str, np.ndarray], bow1: np.ndarray, limit: int, root: np.ndarray, ids: np.ndarray, one: np.ndarray, two: np.ndarray) -> dict[str, np.ndarray]:
    """For every token, lp: its log10 probability as far as the head knows; below: the same without transitions of one
    word; above: what a long state multiplies it by; shallow, deep: whether a transition of one word, or a long state or
    transition, of the tables may change it; far: whether the state of the word before is in the tables only.

    `root` is the log10 probability of every token by its count. Of a token that is no symbol only what its states
    multiply its count's probability by.
    """
    lp = root.copy()
    above, shallow, deep = np.zeros(len(ids)), np.zeros(len(ids), bool), np.zeros(len(ids), bool)
    fit = (one >= 0) & (one < limit)
    far = fit & (one >= len(bow1))
    has = np.flatnonzero(fit & ~far)
    bow = bow1[one[has]]
    has, bow = has[~np.isnan(bow)], bow[~np.isnan(bow)]
    lp[has] += bow
    below = lp.copy()
    key = np.where(ids[has] >= 0, one[has] << BITS | ids[has], -1)
    stored = _looked_up(head["move1"], head["move1_value"], key)
    lp[has] = np.where(np.isnan(stored), lp[has], stored)
    if len(head["move1_filter"]):
        shallow[has] = np.isnan(stored) & (key >= 0) & passes(head["move1_filter"], key)
    has = np.flatnonzero(fit & (two >= 0) & (two < limit))
    context = two[has] << BITS | one[has]
    if len(head["state_filter"]):
        deep[has] = passes(head["state_filter"], context)
    place = found_in(head["state"], context)
    fit = place >= 0
    has, place, context = has[fit], place[fit], context[fit]
    bow = head["state_value"][place]
    deep[has] = False
    key = np.where(ids[has] >= 0, place << BITS | ids[has], -1)
    stored = _looked_up(head["move2"], head["move2_value"], key)
    if len(head["move2_filter"]):
        deep[has] = np.isnan(stored) & (key >= 0) & passes(head["move2_filter"], _mixed(context, ids[has]))
    above[has] = bow
    shallow[has] &= np.isnan(stored)
    lp[has] = np.where(np.isnan(stored), lp[has] + bow, stored)
    deep |= far
    shallow &= ~deep
    lp[shallow | deep] = 0.0
    return {"lp": lp, "above": above, "below": below, "shallow": shallow, "deep": deep, "far": far}


SCORED = (
    "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, "
    "shallow array<struct<pair:bigint,above:double,below:double>>, deep array<struct<context:bigint,x:bigint,pair:bigint,one:bigint,below:double>>"
)


def _scored(corpus: Corpus, tree: Tree) -> DataFrame:
    """Every row's sums over the tokens that the head settles, with the open ones beside them."""
    shared = corpus.rows.sparkSession.sparkContext.broadcast((tree.symbols, tree.head, tree.bow1, tree.limit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, head, bow1, limit = shared.value
        firsts = symbols.first()
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, first = _symbols_of(batch)
            one, two = contexts(ids, first)
            base = symbols.roots(ids, firsts)
            known_of = settle(head, bow1, limit, base, ids, one, two)

            def listed(mask: np.ndarray, columns: dict[str, np.ndarray]) -> pa.ListArray:
                at = np.flatnonzero(mask)
                struct = pa.StructArray.from_arrays([pa.array(c[at], mask=c[at] < 0 if c.dtype == np.int64 else None) for c in columns.values()], list(columns))
                return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.append(first, len(ids))), pa.int32()), struct)

            pair = np.where((ids >= 0) & (one >= 0), one << BITS | ids, -1)
            shallow = listed(known_of["shallow"], {"pair": pair, "above": known_of["above"], "below": known_of["below"]})
            deep = listed(known_of["deep"], {
                "context": np.where(two >= 0, two << BITS | one, -1), "x": ids, "pair": pair, "one": np.where(known_of["far"], one, -1), "below": known_of["below"]
            })
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), batch.column("doc_id"), batch.column("held_out"), batch.column("ids").value_lengths().cast(pa.int64()),
                pa.array(np.add.reduceat((ids >= 0).astype(np.int64), first)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(known_of["lp"], first)), shallow, deep,
            ], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "shallow", "deep"])

    return corpus.rows.select("row", "doc_id", "held_out", "ids").mapInArrow(run, SCORED)


def _opened(scored: DataFrame, tree: Tree) -> DataFrame:
    """(row, opened): the tokens that the head left open, in the longest states of the tables.

    A transition that the head lacks is rare by choice of the head, so few tokens get here and no key is hot.
    """
    moves = tree.transitions[1].select(_pair("context", "x").alias("pair"), F.col("lp").alias("lp1"))
    shallow = scored.select("row", F.explode("shallow").alias("o")).select("row", "o.*").join(moves, "pair", "left")
    deep = scored.select("row", F.explode("deep").alias("o")).select("row", "o.*")
    deep = deep.join(tree.states[2].select("context", F.col("bow").alias("above")), "context", "left")
    deep = deep.join(tree.transitions[2].select("context", "x", F.col("lp").alias("lp2")), ["context", "x"], "left").join(moves, "pair", "left")
    if tree.limit > len(tree.bow1):
        far = tree.states[1].select(F.col("context").alias("one"), F.col("bow").alias("far"))
        deep = deep.join(far, "one", "left").withColumn("below", F.col("below") + F.coalesce("far", F.lit(0.0)))
    plain = F.coalesce("above", F.lit(0.0)) + F.coalesce("lp1", "below")
    lps = shallow.select("row", plain.alias("lp")).unionByName(deep.select("row", F.coalesce("lp2", plain).alias("lp")))
    return lps.groupBy("row").agg(F.sum("lp").alias("opened"))


def score_documents(corpus: Corpus, tree: Tree) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, one row for each row of the documents.

    A null text is empty and has only its end; a null id counts as the empty text when rows are held out. Repeated
    rows are learned from and scored each. Without training rows every token is unknown and has probability one.
    """
    symbols = tree.symbols
    scored = _scored(corpus, tree)
    # where the head holds the whole tree no token is open
    if tree.whole:
        out = scored.drop("shallow", "deep").withColumn("opened", F.lit(0.0))
    else:
        scored = cut(scored)
        out = scored.drop("shallow", "deep").join(_opened(scored, tree), "row", "left")
    out = out.join(corpus.rare, "row", "left")

    def more(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + more("rare_known")).alias("n_known"), F.lit(symbols.total).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + more("rare_lp")).alias("base_score"), (F.col("score") + more("rare_lp") + more("opened")).alias("score"),
    )
