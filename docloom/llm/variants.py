"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

The letters are dealt to GROUPS groups of about equal weight. A word is the path of its length and of its count in
each group; two words one edit apart differ on their paths by one surplus and one deficit at most. The trie is
searched depth first with that budget. Its top, the nodes that hold more than SHARD words, lies on every task; the
subtrees below are shards. Every word is sent to its own subtree and, as a visitor with what is left of its budget,
to the subtrees behind its own that the budget reaches, so that every pair meets once. Words that reach a leaf
together are compared letter by letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import pieces, streamed, utf8
from docloom.plans.stage import cut

LEAST_LENGTH = 7
LEAST_COUNT = 2
DAMAGE = 31
RATIO = 10
GROUPS = 16
SHARD = 16_384
VISITORS = 65_536  # visitors of a subtree that are searched for together
LEAF = 2_048  # words times visitors of a node that are compared without going deeper
FLUSH = 200_000
PATH_TOP = 30_000  # larger counts of endless words count as this, which only adds candidates
WIDE = 64
_RUN = re.compile(r"[a-z\u00C0-\u00FF]+")


def damaged_words(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """(word, n): runs of Latin letters of whole texts, some with one letter deleted, and how often each occurs.

    Runs and ids are taken as they are: a null text has no runs, a null id counts as empty, repeated rows count again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})
            found.clear()
            return out

        for batch in pieces(batches):
            for key, text in zip(utf8(batch, "doc_id"), utf8(batch, "text"), strict=True):
                for word, n in Counter(_RUN.findall(text.lower().decode())).items():
                    if len(word) < least:
                        continue
                    h = zlib.crc32(key + b":" + word.encode())
                    if h % DAMAGE == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                        if len(word) < least:
                            continue
                    found[word] += n
                if len(found) > FLUSH:
                    yield flush()
        if found:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def letter_groups(words: DataFrame, groups: int = GROUPS) -> np.ndarray:
    """The group of every code point up to 255: letters by falling weight in the words, each to the lightest group."""
    letter = F.explode(F.split("word", "")).alias("letter")
    weights = words.select(letter).groupBy("letter").count().where("letter <> ''").collect()  # one row per letter, at most 256
    table, load = np.zeros(256, np.int64), [0] * groups
    for row in sorted(weights, key=lambda r: (-r["count"], r["letter"])):
        g = min(range(groups), key=lambda i: (load[i], i))
        table[ord(row["letter"]) & 255] = g
        load[g] += row["count"]
    return table


def paths(words: list[str], table: np.ndarray, groups: int) -> np.ndarray:
    """One row per word: its length, then its letter count in every group."""
    raw = [w.encode("latin-1") for w in words]
    sizes = np.array([len(r) for r in raw], np.int64)
    letters = table[np.frombuffer(b"".join(raw), np.uint8)]
    owner = np.repeat(np.arange(len(raw)), sizes)
    counts = np.bincount(owner * groups + letters, minlength=len(raw) * groups).reshape(len(raw), groups)
    return np.minimum(np.column_stack([sizes, counts]), PATH_TOP).astype(np.int16)


def trie_top(words: DataFrame, table: np.ndarray, groups: int, shard: int) -> dict[tuple, dict[int, int]]:
    """The nodes with more than `shard` words, each with the sizes of its children: at most depth * words / shard nodes."""

    def run(batches: Iterator[pa.RecordBatch], depth: int, split: set) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple] = Counter()
        for batch in batches:
            seen.update(p for p in map(tuple, paths(batch.column("word").to_pylist(), table, groups)[:, : depth + 1].tolist()) if p[:depth] in split)
        yield pa.RecordBatch.from_pydict({"node": pa.array([list(p) for p in seen], pa.list_(pa.int32())), "n": pa.array(list(seen.values()), pa.int64())})

    top: dict[tuple, dict[int, int]] = {}
    split: set[tuple] = {()}
    for depth in range(groups + 1):
        if not split:
            break
        counted = words.select("word").mapInArrow(lambda b, d=depth, s=split: run(b, d, s), "node array<int>, n bigint").groupBy("node").agg(F.sum("n").alias("n"))
        split = set()
        for node, n in counted.collect():
            top.setdefault(tuple(node[:-1]), {})[node[-1]] = n
            if n > shard:
                split.add(tuple(node))
    return top


def reached(path: tuple, top: dict[tuple, dict[int, int]]) -> Iterator[tuple[tuple, int, int]]:
    """(subtree, surplus left, deficit left) of all subtrees that a word meets, its own first; depth first, only forwards.

    Two words of equal length have as much surplus as deficit; the longer of two has surplus only.
    """
    todo = [((), 1, 1, True)]
    while todo:
        node, more, less, same = todo.pop()
        children = top.get(node)
        if children is None:
            yield node, more, less
            continue
        own, at = path[len(node)], len(node)
        if at == 0:
            steps = [(own + 1, 1, 0), (own, 1, 1)]
        else:
            steps = [(own + 1, more - 1, less)] * more + [(own - 1, more, less - 1)] * (less and not same) + [(own, more, less)]
        todo += [((*node, c), m, d, same and c == own) for c, m, d in steps if c in children]


class Letters:
    """Words as two tables of bytes, flush left and flush right; words over WIDE bytes are empty in both."""

    def __init__(self, words: list[str]):
        self.raw = [w.encode("latin-1") for w in words]
        self.sizes = np.array([len(r) for r in self.raw], np.int64)
        short = [r if len(r) <= WIDE else b"" for r in self.raw]
        self.left, self.right = (np.frombuffer(b"".join(f(r, WIDE, b"\0") for r in short), np.uint8).reshape(-1, WIDE) for f in (bytes.ljust, bytes.rjust))


def one_edit(a: Letters, b: Letters, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs a[i], b[j] differ by exactly one inserted, deleted or replaced code point."""
    good, longest = np.zeros(len(i), bool), np.maximum(a.sizes[i], b.sizes[j])
    for k in np.flatnonzero(longest > WIDE).tolist():
        x, y, top = a.raw[i[k]], b.raw[j[k]], longest[k]
        p = next((t for t, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))
        good[k] = x != y and abs(len(x) - len(y)) <= 1 and x[p + (len(x) == top) :] == y[p + (len(y) == top) :]
    short = np.flatnonzero((longest <= WIDE) & (abs(a.sizes[i] - b.sizes[j]) <= 1))
    wide = int(longest[short].max(initial=1))
    for at in range(0, len(short), 1 << 14):
        k = short[at : at + (1 << 14)]
        x, y = i[k], j[k]
        front, back = a.left[x, :wide] != b.left[y, :wide], a.right[x, WIDE - wide :] != b.right[y, WIDE - wide :]
        good[k] = front.any(1) & (front.argmax(1) + back[:, ::-1].argmax(1) >= longest[k] - 1)
    return good


class Subtree:
    """The words of one shard, which share the first `depth` steps, in the order of their paths: a node is a range of rows."""

    def __init__(self, words: list[str], counts: list[int], table: np.ndarray, groups: int, depth: int = 0):
        at = paths(words, table, groups)
        order = sorted(range(len(words)), key=lambda k: (at[k].tolist(), words[k]))
        self.words, self.n = [words[k] for k in order], np.array([counts[k] for k in order], np.int64)
        self.depth = depth
        self.paths, self.letters = at[order], Letters(self.words)

    def meetings(self, who: np.ndarray, more: np.ndarray, less: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(visitor, word) candidates: all pairs whose paths differ by no more than each visitor's budget, and some others."""
        todo = [(0, len(self.words), self.depth, np.arange(len(who)), more, less)]
        while todo:
            lo, hi, depth, rows, more, less = todo.pop()
            if depth == self.paths.shape[1] or (hi - lo) * len(rows) <= LEAF:
                yield np.repeat(rows, hi - lo), np.tile(np.arange(lo, hi), len(rows))
                continue
            own = who[rows, depth]
            column = self.paths[lo:hi, depth]
            edges = np.flatnonzero(np.diff(column)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), hi - lo]):
                step = int(column[a]) - own
                m, d = more - np.maximum(step, 0) * (depth > 0), less + np.minimum(step, 0) * (depth > 0)
                if depth == 0:  # the length: a longer word leaves no deficit, a shorter one no surplus
                    m, d = np.where(step < 0, 0, m), np.where(step > 0, 0, d)
                fit = (m >= 0) & (d >= 0) & (abs(step) <= 1)
                if fit.any():
                    todo.append((lo + a, lo + b, depth + 1, rows[fit], m[fit], d[fit]))


def near_words(words: DataFrame, shard: int = SHARD, groups: int = GROUPS) -> DataFrame:
    """word, n_near and best (the near word of largest n, ties to the smallest), for the words that have a near word.

    `words` holds each word once, of code points up to 255, with its count n.
    """
    table = letter_groups(words, groups)
    top = trie_top(words, table, groups, shard)
    sent = "shard string, role int, word string, n bigint, more int, less int, peer boolean"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4096):
            out: list[tuple] = []
            names, counts = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            for word, n, path in zip(names, counts, map(tuple, paths(names, table, groups).tolist())):
                for node, more, less in reached(path, top):
                    name, own = ",".join(map(str, node)), path[: len(node)] == node
                    size = top.get(node[:-1], {}).get(node[-1], 0) if node else 0
                    blocks = -(-size // shard) if len(node) == groups + 1 else 1
                    home = zlib.crc32(word.encode()) % max(1, blocks)
                    if own:
                        out.append((f"{name}#{home}", 0, word, n, more, less, True))
                    out += [(f"{name}#{k}", 1, word, n, more, less, own) for k in range(max(1, blocks))]
            columns = zip(*out) if out else [[]] * 7
            types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["shard", "role", "word", "n", "more", "less", "peer"])

    def hold(rows: pa.Table) -> Subtree:
        node = rows.column("shard")[0].as_py().split("#")[0]
        depth = node.count(",") + 1 if node else 0
        return Subtree(rows.column("word").to_pylist(), rows.column("n").to_pylist(), table, groups, depth)

    def meet(tree: Subtree, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        names, n = rows.column("word").to_pylist(), np.array(rows.column("n").to_pylist(), np.int64)
        who, letters = paths(names, table, groups), Letters(names)
        peer = np.array(rows.column("peer").to_pylist(), bool)
        budget = [np.array(rows.column(c).to_pylist(), np.int32) for c in ("more", "less")]
        # rank of a word of the same subtree in its order, so that only later words are met
        rank = {w: k for k, w in enumerate(tree.words)}
        after = np.full(len(names), -1, np.int64)
        for k in np.flatnonzero(peer).tolist():
            after[k] = rank.get(names[k], -2)
        best: dict[str, list] = {}

        def take(word: str, size: int, other: str) -> None:
            old = best.setdefault(word, [0, 0, ""])
            old[0] += 1
            if (-size, other) < (-old[1], old[2]) or not old[2]:
                old[1:] = [size, other]

        def check(pairs: list[tuple[np.ndarray, np.ndarray]]) -> None:
            i, j = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
            later = j > after[i]
            i, j = i[later], j[later]
            gap = tree.paths[j, 1:] - who[i, 1:]
            fit = np.abs(gap).sum(1) <= 2
            i, j = i[fit], j[fit]
            for k in np.flatnonzero(after[i] == -2).tolist():  # the peer's own row lies in another block
                if tree.words[j[k]] <= names[i[k]]:
                    j[k] = -1
            i, j = i[j >= 0], j[j >= 0]
            good = one_edit(letters, tree.letters, i, j)
            for a, b in zip(i[good].tolist(), j[good].tolist()):
                take(names[a], int(tree.n[b]), tree.words[b])
                take(tree.words[b], int(n[a]), names[a])

        pairs, held = [], 0
        for i, j in tree.meetings(who, *budget):
            pairs.append((i, j))
            held += len(i)
            if held > 1 << 18:
                check(pairs)
                pairs, held = [], 0
        if pairs:
            check(pairs)
        yield pa.RecordBatch.from_pydict({
            "word": pa.array(list(best), pa.string()), "n_near": pa.array([v[0] for v in best.values()], pa.int64()),
            "form_n": pa.array([v[1] for v in best.values()], pa.int64()), "form": pa.array([v[2] for v in best.values()], pa.string()),
        })

    shards = max(1, sum(len(c) for c in top.values()))
    met = streamed(words.mapInArrow(send, sent), "shard", "role", shards, hold, meet, "word string, n_near bigint, form_n bigint, form string", VISITORS)
    pick = F.min(F.struct((-F.col("form_n")).alias("order"), "form", "form_n")).alias("best")
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), pick)


def group_variants(docs: DataFrame, least: int = LEAST_LENGTH, count: int = LEAST_COUNT, ratio: int = RATIO, shard: int = SHARD) -> DataFrame:
    """word, form, root, n, n_near and form_n of every frequent enough word of `docs`.

    The form of a word is its near word of largest count, if that count is at least `ratio` times its own; the root is
    where the forms lead. Empty tables and texts give no rows; words of equal count never lead to each other, so
    there are no rings.
    """
    words = cut(damaged_words(docs, least).where(F.col("n") >= count))
    near = near_words(words, shard)
    joined = words.join(near, "word", "left")
    strong = F.col("best.form_n") >= F.lit(ratio) * F.col("n")
    table = cut(joined.select(
        "word", F.when(strong, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(strong, F.col("best.form_n")).alias("form_n"),
    ))
    # pointer doubling over the words that have a form; each step at least multiplies the count by the ratio, so few rounds do
    links = table.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    links = cut(links)
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = cut(moved)
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return table.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# the same words, near pairs and roots in SQL; near words share a deletion at one place, or one is a deletion of the other
VARIANTS_SQL = r"""
WITH RECURSIVE c AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc),
r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
g AS (SELECT id, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL),
b AS (
  SELECT run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END)) AS bytes FROM g),
h AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda a, x: xor(a >> 8, crc[(xor(a, x) & 255) + 1]))) AS h FROM b, c),
t AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM t WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
i AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w),
d AS (SELECT word, i, substr(word, 1, CAST(i - 1 AS INTEGER)) || substr(word, CAST(i + 1 AS INTEGER)) AS v FROM i),
o AS (SELECT DISTINCT d.word AS longer, d.v AS shorter FROM d JOIN w ON d.v = w.word),
p AS (
  SELECT DISTINCT a.word AS word, b.word AS other FROM d a JOIN d b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT longer, shorter FROM o UNION ALL SELECT shorter, longer FROM o),
k AS (SELECT p.word, p.other, w.n, row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, p.other) AS at, count(*) OVER (PARTITION BY p.word) AS n_near FROM p JOIN w ON p.other = w.word),
f AS (
  SELECT w.word, w.n, coalesce(k.n_near, 0) AS n_near, CASE WHEN k.n >= 10 * w.n THEN k.other END AS form, CASE WHEN k.n >= 10 * w.n THEN k.n END AS form_n
  FROM w LEFT JOIN k ON w.word = k.word AND k.at = 1),
s AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT s.word, f.word, f.form FROM s JOIN f ON s.next = f.word)
SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n FROM f JOIN s ON f.word = s.word AND s.next IS NULL
"""
